"""The pipeline's stages on the small table, each against what it should keep."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tests.llm.test_operators import brute_components  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as C
    from plumbline.llm.common import stored, table

    docs, out = table(spark, SF, "documents"), {}
    for name, f in C.STAGES:
        docs = stored(f(spark, docs, SF), name)
        out[name] = docs
    return out


def test_columns_and_clean_documents_stay(spark, stages):
    import corpus_pipeline as C

    names = [n for n, _ in C.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "pii", "packing"]
    for n in names[:-1]:
        assert stages[n].columns == C.COLUMNS
    assert stages["language"].count() >= 195
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["toxicity"].select("doc_id").collect()}
    before = {r.doc_id for r in stages["language"].select("doc_id").collect()}
    assert all(labels.get(i) != 0 for i in before - kept)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    want = {i for i, c in brute_components(rows, 5).items() if i == c}
    assert {r.doc_id for r in stages["near_duplicates"].select("doc_id").collect()} == want


def test_nothing_is_lost_after_that(stages):
    ids = {r.doc_id for r in stages["near_duplicates"].select("doc_id").collect()}
    assert {r.doc_id for r in stages["pii"].select("doc_id").collect()} == ids
    assert {r.doc_id for r in stages["packing"].select("doc_id").collect()} == ids


def odd(spark, rows):
    """Documents with a clashing extra column for every name that a stage makes up."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(9) for c in ("lang_pred", "score", "toxicity", "pii", "kept", "component_id", "ids", "part", "start", "id", "h")})


LONG = "the cat sat on the mat and saw the dog run over the hill with a ball " * 4000
ODD = [
    (1, None, "en", "s", None),
    (2, "", None, None, 0),
    (3, "12 34", "en", "s", 5),
    (4, LONG, "en", "s", len(LONG)),
    (4, LONG, "en", "s", len(LONG)),
    (5, LONG + "end", "en", "s", len(LONG) + 3),
    (None, LONG, "en", "s", len(LONG)),
    (6, "one two three four five six card 4012888888881881", "en", "s", 49),
    (7, "one two three four five six card 4012888888881881", "en", "s", 49),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_every_stage_on_odd_rows(spark, rows):
    import corpus_pipeline as C

    docs = odd(spark, rows)
    out = {}
    for name, f in C.STAGES:
        got = f(spark, docs, SF)
        if name != "packing":
            assert got.columns == C.COLUMNS
        out[name] = got.collect()
    if not rows:
        assert not any(out.values())
        return
    ids = {k: sorted((r.doc_id for r in v), key=str) for k, v in out.items()}
    assert {1, 2, 3}.isdisjoint(ids["language"]) and ids["language"].count(4) == 2
    assert len(out["toxicity"]) == len(rows)
    # rows of one id stay together, one id of each group stays, and rows without an id stay
    assert ids["near_duplicates"] == sorted([1, 2, 3, 4, 4, None, 6], key=str)
    assert ids["pii"] == sorted((r[0] for r in rows), key=str)
    texts = {r.text for r in out["pii"] if r.doc_id in (6, 7)}
    assert len(texts) == 1 and "4012888888881881" not in texts.pop()
    assert {r.n_chars for r in out["pii"] if r.doc_id == 1} == {None}
    pieces = {}
    for r in out["packing"]:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == {r[0] for r in rows} and sum(r.length for r in pieces[4]) == 2 * pieces[4][0].doc_tokens
    assert [r.length for r in pieces[1]] == [1]


def test_stages_make_tasks_hold_little(spark, tmp_path):
    """Spark's default row groups of 128 MB, one read and one written by each task, did not fit a small heap."""
    import corpus_pipeline as C
    import pyarrow.parquet as pq

    own = spark.newSession()  # other tests' stages have set up the shared one
    text = "concat_ws('', transform(sequence(1, 600), i -> sha2(concat(id, '-', i), 256)))"
    docs = own.range(0, 900, 1, 1).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", "'s' AS source", "38400L AS n_chars")
    C.toxic(own, docs, SF).write.parquet(str(tmp_path / "out"))
    groups = [m.row_group(i) for f in (tmp_path / "out").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 900
    assert max(g.total_byte_size for g in groups) < 24 << 20 < sum(g.total_byte_size for g in groups)
    assert int(own.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_stages_leave_own_settings(spark):
    import corpus_pipeline as C
    from plumbline.llm.common import table

    own = spark.newSession()
    given = {"parquet.block.size": "1048576", "spark.sql.parquet.columnarReaderBatchSize": "1000"}
    for k, v in given.items():
        own.conf.set(k, v)
    C.private(own, table(own, SF, "documents"), SF)
    assert {k: own.conf.get(k) for k in given} == given
