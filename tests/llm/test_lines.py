import hashlib
import random
import re

from pyspark.sql import functions as F

from blockloom.llm import lines

SPACE = "[\x20\x09-\x0d]"


def plain(rows, least=10, most=1):
    key = lambda x: re.sub(f"^{SPACE}+|{SPACE}+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held.setdefault(key(x), set()).add(i)
    first = {k: min(v, key=lambda i: (i is None, i or 0)) for k, v in held.items() if len(v) > most}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in first or first[key(x)] == i]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def rows_of(n=300):
    draw = random.Random(2)
    common = ["subscribe to our newsletter", "  Terms of Service apply ", "\tterms of service APPLY\x0b", "short", "ÄÖÜ äöü ñ é", "äöü äöü ñ é", "nine char", "ten chars!", " padded by no ASCII ", "x" * 400, "", " "]
    line = lambda: draw.choice(common) if draw.random() < 0.5 else f"line {draw.randrange(200)} of {draw.randrange(3)} kinds"
    return [(i, "\n".join(line() for _ in range(draw.randrange(12)))) for i in range(n)]


def test_same_as_plain(spark, documents):
    rows = rows_of()
    rows += [(5000 + k, rows[7][1]) for k in range(200)]  # one large group of copies
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, "another text of the same id\nline 3 of 1 kinds\r"), (None, "only null ids hold this"), (None, "only null ids hold this"), (None, rows[9][1]), (9001, None), (9002, ""), (9003, "\n\n"), (9004, "subscribe to our newsletter")]
    assert found(lines.op12_lines(documents(rows))) == plain(rows)


def test_threshold_and_length(spark, documents):
    rows = [(i, f"in all of them\nin only {'three' if i < 3 else 'two of' if i < 5 else i}") for i in range(8)]
    got = lines.deduplicated(documents(rows), least=3, most=2).select("doc_id", "_n_lines", "_n_dropped", F.sha2("text", 256))
    assert found(got) == plain(rows, 3, 2)
    assert sum(r._n_dropped for r in lines.deduplicated(documents(rows), most=9).collect()) == 0


def test_very_long_text(spark, documents):
    many = "\n".join(f"sentence number {k % 70_000}" for k in range(200_000))
    rows = [(1, "sentence number 5\nof its own here"), (2, many), (3, many + "\n" + "y" * 3_000_000), (0, "y" * 3_000_000)]
    assert found(lines.op12_lines(documents(rows))) == plain(rows)


def test_other_columns_and_kept_text(spark):
    shape = "k int, text string, _n_lines string, doc_id string, d1 array<int>, `_dropped` int, `a b` double"
    rows = [(1, "same line as there\nown", "p", "b", [1], None, 0.5), (2, "own\nSAME line as there ", "q", "a", None, 3, None)]
    got = lines.deduplicated(spark.createDataFrame(rows, shape))
    assert got.columns == ["k", "text", "_n_lines", "doc_id", "d1", "_dropped", "a b", "_n_lines_", "_n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(1, "own", "p", "b", [1], None, 0.5, 2, 1), (2, "own\nSAME line as there ", "q", "a", None, 3, None, 2, 0)]


def test_empty_table(spark, documents):
    assert lines.op12_lines(documents([])).collect() == []
    assert found(lines.op12_lines(documents([(None, None)]))) == plain([(None, None)])


def test_clash_in_other_case(spark):
    got = lines.deduplicated(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, _N_LINES int"))
    assert got.columns[-2:] == ["_n_lines_", "_n_dropped"]
