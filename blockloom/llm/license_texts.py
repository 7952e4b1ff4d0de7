"""Licence texts, headers and statements that files are compared with: fixed values, as their publishers word them."""

_GPL = (
    "This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} "
    "either version {v} of the License, or (at your option) any later version."
)
_LESSER = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
    "either version {v} of the License, or (at your option) any later version."
)
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_12 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_FREE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_REST = (
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_MPL_REST = "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."


def _gnu(name: str, v: str, date: str) -> list[str]:
    """The title of the licence file, notices as headers have them, and one-line statements."""
    return [f"GNU {name.upper()} Version {v}, {date}", *[_GPL.format(name=name, v=v, colon=c, comma=m) for c, m in ((":", ","), (";", ";"))], f"This work is licensed under the GNU {name}, version {v}."]


def _cc(kind: str, words: str) -> list[str]:
    return [f"Licensed under CC {kind} 4.0.", f"This work is licensed under a Creative Commons {words} 4.0 International License.", f"Creative Commons {words} 4.0 International Public License"]


TEMPLATES: dict[str, list[str]] = {
    "0BSD": ["BSD Zero Clause License", _ISC_FREE, f"{_ISC_FREE} {_ISC_END}"],
    "AGPL-3.0": [*_gnu("Affero General Public License", "3", "19 November 2007"), "This program is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0.", _APACHE, _APACHE_REST, f"{_APACHE} {_APACHE_REST}"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Released under the BSD 2-Clause License.", f"{_BSD} {_BSD_12} {_BSD_END}"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Released under the BSD 3-Clause License.", _BSD_3, f"{_BSD} {_BSD_12} {_BSD_3} {_BSD_END}"],
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "Creative Commons Legal Code CC0 1.0 Universal"],
    "GPL-2.0": _gnu("General Public License", "2", "June 1991"),
    "GPL-3.0": _gnu("General Public License", "3", "29 June 2007"),
    "ISC": ["ISC License", "Released under the ISC License.", _ISC, f"{_ISC} {_ISC_END}"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _LESSER.format(v="2.1")],
    "LGPL-3.0": [*_gnu("Lesser General Public License", "3", "29 June 2007"), _LESSER.format(v="3"), "This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["The MIT License (MIT)", "MIT License", "Released under the MIT License.", "Licensed under the MIT License.", _MIT, f"{_MIT} {_MIT_NOTICE} {_NO_WARRANTY}"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", _MPL, f"{_MPL} {_MPL_REST}"],
    "Unlicense": [_UNLICENSE, f"{_UNLICENSE} {_UNLICENSE_REST}"],
}
for _name, _some in TEMPLATES.items():
    _some.append(f"SPDX-License-Identifier: {_name}")
for _name in [n for n in TEMPLATES if "GPL" in n]:
    TEMPLATES[_name] += [f"SPDX-License-Identifier: {_name}-only", f"SPDX-License-Identifier: {_name}-or-later"]
