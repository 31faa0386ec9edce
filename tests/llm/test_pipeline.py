"""The pipeline against a plain version of each stage, held on the stage's own input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessella.llm import secrets  # noqa: E402
from tessella.runtime import materialize  # noqa: E402
from tests.llm.test_mixing import plain_targets  # noqa: E402
from tests.llm.test_simhash import plain_components, plain_fingerprint  # noqa: E402
from tests.llm.test_tokens import check_places, pieces_of  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, data, documents):
    found, docs = [documents], documents
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data))
        found.append(docs)
    return found


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_drops_rows_and_keeps_good_ones(stages, spark, data):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[:2])
    assert set(after) < set(before) and all(after[i] == before[i] for i in after)
    good = [i for i in before if labels.get(i) == 1 and len(before[i].text.split()) >= 10]
    assert sum(i in after for i in good) >= 0.99 * len(good)


def test_one_of_each_group_stays(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    groups = plain_components({i: plain_fingerprint(t) for i, t in before.items()})
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(groups.values()))


def test_secrets_are_gone(stages):
    path = secrets.public_tokenizers.path("byte_bpe_50k.tiktoken")
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        assert r.text == secrets.redact(before[r.doc_id], path) and r.n_chars == len(r.text)
        assert not secrets.find_secrets(r.text, path)


def test_sources_are_near_their_targets(stages):
    words = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    before, after = words(stages[3].collect()), words(stages[4].collect())
    for source, target in plain_targets(before).items():
        assert abs(after.get(source, 0) - target) <= max(150, 0.03 * target)  # whole copies of a few documents


def test_everything_is_packed(stages):
    rows = stages[5].collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(pieces_of([(r.doc_id, r.text) for r in stages[4].collect()]))
    check_places(rows)


def test_run_gives_the_last_stage(spark, data, stages):
    assert corpus_pipeline.run(spark, data).count() == stages[-1].count()


def test_odd_and_empty_tables_pass_every_stage(spark, data, odd, empty):
    """Nulls, blanks, a very long text, repeated rows, a missing id and clashing or dotted names; then no rows at all."""
    for rows in (odd, empty):
        docs, few = rows, rows.count()
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, materialize(stage(spark, docs, data))
            if "sequence_id" not in docs.columns:
                assert docs.columns == before
        assert "sequence_id" in docs.columns and (few or docs.count() == 0)
    for _, stage in corpus_pipeline.STAGES:  # and each stage takes the odd table itself
        assert stage(spark, odd, data).count() >= 0
