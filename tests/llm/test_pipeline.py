import math
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from blockloom.llm import decontaminate, language, mixing
from blockloom.llm.common import stored, table

from .test_mixing import plain
from .test_pii import PLAIN
from .test_pii import plain as plain_spans
from .test_simhash import plain_components, plain_fingerprint, plain_shingles

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixing"]
    at = {}
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns[: len(columns)] == columns
        at[name] = {r.doc_id: r for r in docs.collect()} if name != "mixing" else docs.collect()
    raw = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    said = {r.doc_id: r for r in language.op2_language(table(spark, SF, "documents")).collect()}
    assert set(at["language"]) == {i for i, r in said.items() if r.lang_pred != "und" and r.score >= language.LEAST}
    assert len(at["language"]) > 0.99 * len(raw)

    ids = sorted(at["language"])
    fp = [plain_fingerprint(raw[i].text, 5) for i in ids]
    sets = [plain_shingles(raw[i].text, 5) for i in ids]
    near = lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0
    root = plain_components(range(len(ids)), [(i, j) for i, j in combinations(range(len(ids)), 2) if near(i, j)])
    assert set(at["near_duplicates"]) == {ids[k] for k in set(root.values())}

    items = [decontaminate.normal(r.text) for r in table(spark, SF, "benchmark").collect()]
    whole = {i for i in at["near_duplicates"] if not any(x in decontaminate.normal(raw[i].text) for x in items)}
    assert set(at["decontamination"]) <= whole and len(at["decontamination"]) >= len(whole) - 2

    for i, r in at["personal_data"].items():
        assert r.n_chars == len(r.text)
        if not plain_spans(raw[i].text) and "<id>" not in r.text:
            assert r.text == raw[i].text
        assert not re.search(PLAIN["email"], r.text)

    rows = [(i, r.text, r.lang, r.source) for i, r in at["personal_data"].items()]
    size, has, target = plain(rows)
    taken, copies, word_count = Counter(), Counter(r.doc_id for r in at["mixing"]), dict(zip([r[0] for r in rows], size))
    for r in at["mixing"]:
        taken[r.source] += word_count[r.doc_id]
    assert max(copies.values()) <= mixing.MOST
    for s, t in target.items():
        assert abs(taken[s] - t) <= 3 * max(z for z, r in zip(size, rows) if r[3] == s) + 1 and math.isfinite(float(t))


NAMES = ["_row", "_r", "_of", "_lang", "_score", "_items", "_spans", "copy", "_copies", "_at", "_text", "_rate", "__0", "fp", "component_id", "node", "size", "_k0"]


@pytest.mark.parametrize("stage", range(5))
def test_clashing_columns_keep_their_values(spark, documents, stage):
    rows = [(i, f"the cat number {i} and the dog sat on the mat in house {i * 7} and " + "rain is rain " * (i % 5), "en", f"s{i % 3}") for i in range(30)]
    docs = documents(rows).drop("size")
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    got = pipeline.STAGES[stage][1](spark, docs, SF)
    assert got.columns == [*docs.columns, "copy_"][: len(got.columns)] and len(got.columns) == len(docs.columns) + (stage == 4)
    got = stored(got, "clash").collect()
    assert len(got) > 5 and all(r[name] == f"{k}-{r.doc_id}" for r in got for k, name in enumerate(NAMES))


def test_odd_rows_go_through(spark, documents):
    rows = [(i, f"the cat number {i} and the dog sat on the mat in house {i * 7}", "en", "s") for i in range(40)]
    rows += [(50, None, "en", None), (51, "", None, "s"), (None, "the cat and the dog", "en", "t"), (3, rows[3][1], "en", "s")]
    docs = documents(rows)
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "odd")
    assert docs.columns == [*documents(rows).columns, "copy"]
    empty = documents([])
    for _, stage in pipeline.STAGES:
        empty = stored(stage(spark, empty, SF), "none")
    assert empty.count() == 0
