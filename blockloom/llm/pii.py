"""Personal data: fixed patterns seed lexical contexts, which discover further identifiers by bootstrapping."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, set_aside, stored, texts, with_row_index

KINDS = ("email", "ip", "card", "phone", "id")
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is only tried at its start, where the rest of it would match or fail alike: linear on long runs.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Candidates: white-space separated tokens with a digit or an @, as every seed has one; what surrounds them in a token.
HINT = re.compile(r"[0-9@]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
WRAP = "\"'`.,;:!?()[]{}<>|*$#&%=~"
WHOLE = re.compile(r"\S+")
#: Words, forms and values that are longer than this go by their hash.
LONG = 128
#: A key and a sign that a candidate follows within its token, as in `user="a7"`; what follows may be quoted.
SIGNED = re.compile(r"[^\W\d][\w-]*+[\"']?(?::=|=>|=|:(?!//))[\"']?(?=\S*[0-9@])")
#: Secrets by their key, of which some are seeds: quoted, or as a long run. The runs end at quotes or are taken whole, so it is linear as well.
KEYED = re.compile(
    r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?(?:[_-][a-z0-9_-]{0,32})?[\"']?\s{0,8}(?::=|=>|[:=])\s{0,8}"
    r"(?:([\"'])(?P<quoted>[^\s\"']++)\1|(?P<bare>[A-Za-z0-9_+/.=-]{16,}+))"
)
LETTER = re.compile(r"[A-Za-z]")
#: Length of a quoted secret that may be a seed; digits of a bare one; one secret of so many is a seed, by its value's hash.
SECRET, SECRET_DIGITS, SEEDS = 8, 4, 10
#: Rounds of scoring; confidence and number of distinct known identifiers from which a pattern is trusted.
ROUNDS, TRUST, SUPPORT = 3, 0.8, 4
#: Share of identifiers of one outline in a pattern that are known, from which the others of that outline count as well.
SHARE = 0.05


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As a search for the whole pattern would find them, but from each @ outwards, so that long runs cost no squares."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def keyed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the seeds among secrets that follow a key such as `token =`, but for those that lie within a base span.

    One in SEEDS is a seed, by its value, whatever text it stands in; the contexts have to find the others.
    """
    out = []
    for m in KEYED.finditer(text) if DIGIT.search(text) else ():
        name = "quoted" if m["quoted"] else "bare"
        value, (s, e) = m[name], m.span(name)
        fine = len(value) >= SECRET if name == "quoted" else len(DIGIT.findall(value)) >= SECRET_DIGITS
        fine = fine and zlib.crc32(value.encode("utf-8", "surrogatepass")) % SEEDS == 0
        if fine and LETTER.search(value) and DIGIT.search(value) and not any(b <= s and e <= f for _, b, f in base):
            out.append((KINDS.index("id"), s, e))
    return out


def shape(value: str) -> str:
    """What an identifier looks like: letters a, digits 9, the rest as it is; runs of letters and digits by length."""
    runs = re.sub(r"[^\W\d_]+", lambda m: f"a{len(m[0])}", re.sub(r"[0-9]+", lambda m: f"9x{len(m[0])}", value))
    return f"hex{len(value)}" if len(value) >= 16 and re.fullmatch(r"[0-9a-f]+", value) and not value.isdigit() else runs


def outline(value: str) -> str:
    """The kinds of characters of an identifier that mixes letters and digits, whatever its length; else nothing."""
    kinds = {"a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "a" if c.isalpha() else c for c in set(value)}
    return "".join(sorted(kinds))[:LONG] if "9" in kinds and kinds & {"a", "A"} and "@" not in kinds else ""


def short(x: str) -> str:
    """A name of bounded length for a text of any length."""
    return x if len(x) <= LONG else f"#{hashlib.sha256(x.encode('utf-8', 'surrogatepass')).hexdigest()}"


class Words:
    """The white-space separated tokens of a text, to look up what stands around a span."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [m.span() for m in WHOLE.finditer(text)]
        self.words = [(e, w) for s, e in self.tokens if (w := text[s:e].lower().strip(WRAP))]

    def before(self, start: int) -> list[str]:
        """The two last words before a place, `^` where there are less; marks that stand alone, as in `key = "`, are none."""
        k = bisect_right(self.tokens, (start,)) - 1
        own = self.text[self.tokens[k][0] : start].lower().strip(WRAP) if k >= 0 and self.tokens[k][1] > start else ""
        n = bisect_right(self.words, (start, chr(0x10FFFF)))
        return ["^", "^", *(w for _, w in self.words[max(0, n - 2) : n]), *([own] if own else [])][-2:]

    def after(self, end: int) -> str:
        """The word that follows a place, or the marks that stand there alone."""
        k = bisect_right(self.tokens, (end,)) - 1
        if k < 0 or self.tokens[k][1] <= end:
            k += 1
        if k == len(self.tokens):
            return "^"
        own = self.text[max(end, self.tokens[k][0]) : self.tokens[k][1]]
        return own.lower().strip(WRAP) or own

    def context(self, start: int, end: int) -> list[str]:
        """The lexical contexts that a span lies in: the word before, both words before, and the words on both sides."""
        two, one = map(short, self.before(start))
        return [f"{one} _", f"{two} {one} _", f"{one} _ {short(self.after(end))}"]


def occurrences(text: str, seeds: list[tuple[int, int, int]]) -> list[dict]:
    """All identifiers of a text with their patterns: the seeds, which fixed patterns found, and other candidates.

    A pattern is a context alone, which takes in identifiers of any form, or a context with a form.
    """
    out, taken = [], sorted((s, e) for _, s, e in seeds)
    spans = [(s, e, True) for s, e in taken]
    k, reach = 0, 0
    for m in TOKEN.finditer(text) if HINT.search(text) else ():
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach > m.start():
            continue
        lead = len(m[0]) - len(m[0].lstrip(WRAP))
        if key := SIGNED.match(m[0], lead):
            lead = key.end()
        if value := m[0][lead:].strip(WRAP):
            lead += len(m[0][lead:]) - len(m[0][lead:].lstrip(WRAP))
            spans.append((m.start() + lead, m.start() + lead + len(value), False))
    words = Words(text) if spans else None
    for s, e, seed in spans:
        form, around = short(shape(text[s:e])), words.context(s, e)
        out.append({"start": s, "end": e, "seed": seed, "value": short(text[s:e]), "outline": outline(text[s:e]), "patterns": [*around, *(f"{p} | {form}" for p in around)]})
    return out


SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("value", pa.string()), ("outline", pa.string()), ("patterns", pa.list_(pa.string()))]))
FOUND_SQL = "_base array<struct<kind:int,start:bigint,end:bigint>>, _keyed array<struct<kind:int,start:bigint,end:bigint>>, _found array<struct<start:bigint,end:bigint,seed:boolean,value:string,outline:string,patterns:array<string>>>"


def extract(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns with `_base`, the fixed patterns' spans, `_keyed`, secrets by their keys, and `_found`, all identifiers and their patterns."""

    def run(batches):
        for b in batches:
            base, keyed, found = [], [], []
            for t in texts(b.column(b.num_columns - 1)):
                own = base_spans(t)
                secrets = keyed_spans(t, own)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                keyed.append([{"kind": k, "start": s, "end": e} for k, s, e in secrets])
                found.append(occurrences(t, own + secrets))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(base, SPAN), pa.array(keyed, SPAN), pa.array(found, FOUND)], names=[*b.schema.names[:-1], "_base", "_keyed", "_found"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return docs.select(*carry, F.col("text").cast("binary").alias("_text")).mapInArrow(run, f"{fields}, {FOUND_SQL}")


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(pattern, confidence) of the patterns that mostly hold known identifiers, or such as look like them.

    edges: distinct (pattern, value, seed, outline). A pattern is scored by the mean score of its identifiers, with one
    unknown identifier added; an identifier that is no seed gets the score of its best trusted pattern. Where at least
    support known identifiers of a pattern have one outline, and they are the given share of all of that outline there,
    the others of it count in full: a minority of seeds is enough for a context of secrets, and numbers or words, which
    have no outline, do not gain by it. Scores pass to and fro for some rounds, so patterns that share identifiers with
    trusted ones gain; seeds and identifiers that an earlier round found alike are its support. A context without a form
    so brings in new forms. What a round finds is written, so that each join deals both of its sides anew and Spark can
    split a pattern that holds much of the graph.
    """

    def score(scored: DataFrame) -> DataFrame:
        alike = scored.groupBy("pattern", "outline").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum((F.col("score") > 0).cast("long")).alias("known"))
        full = (F.col("outline") != "") & (F.col("known") >= support) & (F.col("known") >= share * F.col("n"))
        found = alike.groupBy("pattern").agg((F.sum(F.when(full, F.col("n")).otherwise(F.col("score"))) / (F.sum("n") + 1)).alias("confidence"), F.sum("known").alias("known"))
        return stored(found.where((F.col("known") >= support) & (F.col("confidence") >= trust)).drop("known"), "patterns")

    patterns = score(edges.withColumn("score", F.col("seed").cast("double")))
    for _ in range(rounds - 1):
        best = stored(edges.join(patterns, "pattern").groupBy("value").agg(F.max("confidence").alias("found")), "values")
        both = edges.join(best, "value", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))))
        patterns = score(both)
    return patterns


def find_spans(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns with `_base` and `_spans`, arrays of (kind, start, end) in code points, by kind, then start.

    `_spans` holds the base spans and those of kind 4 (id): the seeds among keyed secrets, and what trusted patterns
    discover, which overlaps neither. A secret may hold a base span, but lies in none. An identifier has a digit or an @.
    The pattern graph covers all documents. Null texts are empty; repeated rows and null ids stay rows of their own, and
    count once as a pattern's identifier; very long texts, tokens and neighbours are looked at whole, and patterns of
    equal score are trusted alike. An empty table gives an empty result; other columns, whatever their names, are not
    looked at.
    """
    rows = docs.select(F.struct(*carry).alias("_doc"), "text").withColumn("_at", F.monotonically_increasing_id())
    with scratch() as keep:
        kept = keep(stored(extract(rows, ["_doc", "_at"]), "found"))
        new = keep(stored(discovered(kept), "new"))
    both = kept.drop("_found").join(new.withColumnRenamed("_at", "_of"), F.col("_at") == F.col("_of"), "left")
    known = F.concat("_base", "_keyed")
    return both.select(*[F.col("_doc").getField(c).alias(c) for c in carry], F.array_sort("_base").alias("_base"), F.array_sort(F.when(F.col("_new").isNull(), known).otherwise(F.concat(known, "_new"))).alias("_spans"))


def discovered(kept: DataFrame) -> DataFrame:
    """(_at, _new): the spans that trusted patterns add to each row, of which none is a seed."""
    each = kept.select("_at", F.explode("_found").alias("o")).select("_at", "o.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "value", "seed", "outline").groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.max("outline").alias("outline"))
    trusted = trusted_patterns(stored(edges, "edges"))
    unknown = each.where(~F.col("seed")).select("_at", "start", "end", F.explode("patterns").alias("pattern"))
    return unknown.join(trusted, "pattern", "left_semi").groupBy("_at").agg(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "end")).alias("_new"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; n_chars, where there is one, follows.

    Null texts stay null, empty ones and those without spans as they are; of spans that overlap, the first and longest
    counts. Repeated documents are masked alike, texts of any length whole; all columns stay, whatever their names. An
    empty table stays empty.
    """
    named = set_aside(docs, "text", "n_chars")
    rows = with_row_index(named, "_row")
    with scratch() as keep:
        spans = keep(stored(find_spans(rows, ["_row"]).where(F.size("_spans") > 0).select(F.col("_row").alias("_r"), "_spans"), "spans"))
    both = rows.join(spans, F.col("_row") == F.col("_r"), "left").drop("_row", "_r")
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                parts, done = [], 0
                for s in sorted(spans or (), key=lambda s: (s["start"], -s["end"])):
                    if s["end"] <= done:
                        continue
                    parts += [t[done : s["start"]], f"<{KINDS[s['kind']]}>"] if s["start"] >= done else []
                    done = s["end"]
                out.append("".join([*parts, t[done:]]) if spans else t)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 : -1]], names=b.schema.names[:-1])

    masked = both.mapInArrow(run, named.schema)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return masked.toDF(*docs.columns)


def op9_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_id (secrets and what the patterns added)."""
    found = find_spans(docs, ["doc_id"])
    count = lambda k: F.size(F.filter("_spans", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts[:4], F.sha2(written(F.col("_base")).cast("binary"), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"), counts[4])
