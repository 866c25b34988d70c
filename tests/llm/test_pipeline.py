"""The pipeline against a brute-force version of its stages."""

import collections

import corpus_pipeline
from rillstats.llm import language_id, mixing, near_dedup, secret_scan
from rillstats.llm.common import read_table, stored
from tests.llm.test_operators import brute_links


def test_stages(spark, data):
    docs = read_table(spark, data, "documents")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "mixing"]
    kept, before = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, before, data), f"test-{name}")
        assert name == "mixing" or out.columns == columns
        kept.append(out)
        before = out
    ids = [collections.Counter(r.doc_id for r in k.collect()) for k in kept]
    texts = {r.doc_id: r.text for r in kept[0].collect()}
    components = brute_links(texts, 5)
    assert set(ids[1]) == {i for i, (_, c) in components.items() if c == i}
    items = [r.text for r in read_table(spark, data, "benchmark").collect()]
    gone = {i for i in ids[1] if any(t in texts[i] for t in items)}
    assert gone and set(ids[2]) == set(ids[1]) - gone
    assert set(ids[3]) == set(ids[2])
    model = secret_scan.learnt(kept[2])
    for r in kept[3].collect():
        spans = secret_scan.spans_of(texts[r.doc_id].encode(), model)
        assert r.text == secret_scan.redacted(texts[r.doc_id], spans)
    taken = {r.doc_id: r.copies for r in mixing.mixed(kept[3]).collect()}
    assert ids[4] == collections.Counter({i: n for i, n in taken.items() if n})
    assert language_id.UNKNOWN and near_dedup.BANDS


def test_run_gives_the_last_stage(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert {r.copy for r in out.select("copy").distinct().collect()} <= {1, 2, 3}


def test_rows_with_a_null_id_are_mixed_as_planned(spark):
    texts = [f"t{k % 50} " + "w " * (k % 7) for k in range(90)]
    docs = spark.createDataFrame([(k if k % 3 else None, t, None, "a" if k % 2 else "b", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    planned = mixing.mixed(docs).collect()
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == [*docs.columns, "copy"]
    got = collections.Counter((r.doc_id, len(r.text.split())) for r in out.collect())
    want = collections.Counter()
    for r in planned:
        want[r.doc_id, r.size] += r.copies
    assert got == +want and any(i is None for i, _ in got)


def test_stages_on_odd_tables(spark, data):
    """Nulls in any column, repeated and tied rows, columns whose names clash, an empty table."""
    words = "the quick brown fox jumps over the lazy dog and runs away from it over the hills to the sea where it sleeps in the sun"
    names = ["_id", "size", "copies", "_place", "place", "kept_id", "leaked_id", "own", "row", "h", "pattern", "node", "id", "kept", "text2"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    more = tuple("x" for _ in names)
    rows = [(1, words, "en", "a", 9, *more)] * 2 + [(2, words, "en", "a", 9, *more), (2, words + " more", None, None, None, *more), (3, "Der Hund und die Katze schlafen im Garten hinter dem Haus", "de", "b", 5, *more)]
    rows += [(None, words, "en", "a", 9, *more), (None, words, "en", "a", 9, *more), (4, None, None, None, None, *(None for _ in names)), (5, "", "en", "a", 0, *more), (6, "key = 0123456789abcdef0123456789abcdef and the words around it", "en", "b", 5, *more)]
    docs = spark.createDataFrame(rows, kind)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.where("false"), docs.select("doc_id", "text", "lang", "source")):
            out = stage(spark, given, data)
            assert out.columns == given.columns + ["copy"] * (name == "mixing")
            got = out.collect()
            if given is docs:
                left[name] = collections.Counter(r.doc_id for r in got)
            elif "size" in given.columns:
                assert got == []
    every = collections.Counter(r[0] for r in rows)
    assert left["language_id"] == every - collections.Counter([4, 5])
    assert left["near_dedup"] == collections.Counter([1, 3, None, None, 4, 5, 6])
    assert left["decontamination"] == left["secret_scan"] == every
    assert not {4, 5} & set(left["mixing"])
