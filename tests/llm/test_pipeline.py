import re

import corpus_pipeline
from lodestream.llm import quality_rules
from lodestream.llm.common import written
from tests.llm import helpers
from tests.llm.test_dedup import WORD, deduped, distinct_by_brute_force
from tests.llm.test_private import PLAIN, PROBES, form
from tests.llm.test_quality import counts, gram_score
from tests.llm.test_tokens import expected_pieces, sequences


def keeps(model, text):
    """The quality rules by plain loops."""
    n_words, _, _, _, n_repeat = counts(text)
    return n_words >= 50 and 100 * n_repeat <= 50 * n_words and gram_score(model, text) >= 0.3


def assert_private(old, new, there):
    """What plain patterns find has gone, each replaced by something of its form, the same everywhere (there); all else stays."""
    found = sorted((m.start(), m.end(), kind) for kind, pattern in PLAIN.items() for m in pattern.finditer(old))
    shape, at, originals = "", 0, []
    for start, end, kind in found:
        # addresses change in length; others keep their form character by character
        shape += re.escape(old[at:start]) + (r"([\d.]+)" if kind == "ip" else f"(.{{{end - start}}})")
        at = end
        originals.append((kind, old[start:end]))
    match = re.fullmatch(shape + re.escape(old[at:]), new, re.S)
    assert match, (old, new)
    for (kind, original), surrogate in zip(originals, match.groups(), strict=True):
        assert original.lower() != surrogate.lower()
        assert kind in ("ip", "secret") or form(original) == form(surrogate)
        assert there.setdefault((kind, original.lower()), surrogate.lower()) == surrogate.lower()


def test_stages_follow_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    # the weights are the fit's; all that follows from them is counted again
    model = quality_rules.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in texts.items() if keeps(model, t)}
    assert 0 < len(kept) < len(texts)
    cut = {i: t for i, (t, _, gone) in deduped(sorted(kept.items())).items() if not gone or len(WORD.findall(t)) >= 50}
    stay = {i for _, i in distinct_by_brute_force(list(cut.items()))}
    alone = {i: t for i, t in cut.items() if i in stay}
    assert len(alone) < len(cut)
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], (kept, cut, alone, None), strict=True):
        docs = written(stage(spark, docs, data), spark)
        assert docs.columns == columns, name
        rows = docs.collect()
        got = {r["doc_id"]: r["text"] for r in rows}
        if expected is None:
            there = {}
            for i, text in alone.items():
                assert_private(text, got.pop(i), there)
            assert not got and len(there) > 5 and len(set(there.values())) == len(there)
        else:
            assert got == expected, name
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
    private = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = written(corpus_pipeline.STAGES[-1][1](spark, docs, data), spark).collect()
    assert sum(expected_pieces(private.items()).values()) == len(rows)
    sequences(rows)
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).select("doc_id", "piece", "length").collect())) == sorted((r["doc_id"], r["piece"], r["length"]) for r in rows)


def test_odd_rows(spark, data):
    filler = [" ".join(f"{kind}{i} beta{7 * i}" for i in range(200)) for kind in ("alpha", *(f"k{n}x" for n in range(len(PROBES))))]
    docs = helpers.documents(spark, [*helpers.ODD, filler[0], *(f"{probe} {words}" for probe, words in zip(PROBES, filler[1:], strict=True))])
    folder = helpers.folder(spark, documents=docs, labels=helpers.empty(spark, helpers.LABELS))
    assert corpus_pipeline.run(spark, folder).count() > 0
    folder = helpers.folder(spark, documents=helpers.empty(spark), labels=helpers.empty(spark, helpers.LABELS))
    assert corpus_pipeline.run(spark, folder).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "pii", "packing"]
    assert all(callable(f) for _, f in corpus_pipeline.STAGES)
