"""Each stage against a plain version over the rows that its predecessor kept."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from keyloom.llm import common, mixing, toxicity
from tests.llm.test_packing import check
from tests.llm.test_secrets import plain as plain_spans
from tests.llm.test_similar import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = common.documents(spark, SF), []
    for name, stage in cp.STAGES:
        before, docs = docs, common.stored(stage(spark, docs, SF), name)
        out.append((before, docs))
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scan", "mixing", "packing"]
    for before, after in steps[:-1]:
        assert after.columns == before.columns


def test_toxic_documents_go(spark, steps):
    before, after = steps[0]
    bias, at, w = toxicity.fit(*toxicity.training(spark, SF))
    weights = dict(zip(at.tolist(), w.tolist(), strict=True))
    odds = {r.doc_id: bias + sum(weights.get(f, 0.0) for f in toxicity.features(r.text.encode()).tolist()) for r in before.collect()}
    limit = 0.8472978603872034
    kept = {r.doc_id for r in after.collect()}
    assert all((i in kept) == (x < limit) for i, x in odds.items() if abs(x - limit) > 1e-4)


def test_one_of_each_group_stays(steps):
    """Against all pairs of the stage's documents at five words and a similarity of 0.8."""
    before, after = steps[1]
    assert sorted(r.doc_id for r in after.collect()) == plain_kept([(r.doc_id, r.text) for r in before.collect()])


def test_secrets_are_masked(steps):
    before, after = steps[2]
    new = {r.doc_id: r for r in after.collect()}
    assert len(new) == before.count()
    for r in before.collect():
        want, at = "", 0
        for kind, s, e in sorted(plain_spans(r.text), key=lambda x: (x[1], -x[2])):
            if s >= at:
                want += r.text[at:s] + f"[{kind.upper()}]"
            at = max(at, e)
        want += r.text[at:]
        if "[FORMAT]" not in new[r.doc_id].text:
            assert new[r.doc_id].text == want
        assert new[r.doc_id].n_chars == (r.n_chars if want == r.text else len(want))


def test_mixture_is_that_of_the_sql(steps):
    import duckdb

    before, after = steps[3]
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    cursor = con.execute(mixing.ORACLE)
    names = [c[0] for c in cursor.description]
    want = {}
    for row in cursor.fetchall():
        r = dict(zip(names, row, strict=True))
        if r["taken"]:
            want[r["doc_id"]] = r["taken"] // r["size"]
    assert Counter(r.doc_id for r in after.collect()) == want


def test_sequences_are_sound(steps):
    before, after = steps[4]
    rows = after.collect()
    check(rows)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in before.collect())


def test_run_gives_the_last_stage(spark, steps):
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, cp.run(spark, SF).collect())) == sorted(map(key, steps[-1][1].collect()))


def test_rows_of_every_kind(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (1, "", "en", "a", 0, 2), (2, "token=abcdefabcdef " * 30_000, "en", None, 5, None), (3, "two words", None, "b", 9, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")
    for _, stage in cp.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF), "kinds")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "size"]
    check(cp.STAGES[-1][1](spark, docs, SF).collect())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0
