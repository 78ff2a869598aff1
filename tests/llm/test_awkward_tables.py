"""Every operator and stage on rows that tables have and tests rarely do: nulls anywhere, columns named as the operators' own."""

import pytest

from quillgraph.llm import chat, fingerprint, jaccard, langid, mixing, packing, perplexity, substring, suffix, warc
from quillgraph.llm.queries import vocabulary

from . import data

#: Names that the operators give to columns of their own.
OWN = (
    "id", "row_id", "row_key", "row_text", "row_home", "home", "bucket", "block", "blocks", "band", "bands", "unit", "other", "root", "cluster",
    "class_id", "first", "same", "h", "p", "leaf", "copy", "copies", "taken", "target", "whole", "settled", "one", "number", "more", "n", "least", "rows",
    "piece", "start", "length", "offset", "sequence_id", "a", "b", "at", "entries", "lang_pred", "n_words", "n_removed", "perplexity",
)
PAIRWISE = [substring.dedup, suffix.repeated_spans, jaccard.join]
BY_ROW = [fingerprint.fingerprints, mixing.mix, perplexity.quality, langid.identify]
STAGES = [langid.accepted_documents, jaccard.unique_documents, substring.cleaned_documents, mixing.mixed_documents]
#: Operators that give a row per document, and stages that keep the input's columns.
SOME = [r for r in data.rows(3, 24) if r[0] != 1007] + [(None, None, None, None)] * 2 + [(2000, "word " * 30_000, None, None), (None, "x", "en", None)]


def with_own_names(spark, some=None):
    df = data.frame(spark, SOME if some is None else some)
    return df.selectExpr("*", *[f"CAST(NULL AS STRING) AS `{c}`" if i % 2 else f"CAST({i} AS BIGINT) AS `{c}`" for i, c in enumerate(OWN)])


def plain_rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("operator", [*PAIRWISE, *BY_ROW], ids=lambda f: f.__module__.rsplit(".", 1)[-1])
def test_operators_ignore_columns_named_as_their_own(spark, operator):
    got, plain = operator(with_own_names(spark)), operator(data.frame(spark, SOME))
    assert got.columns == plain.columns
    ids = [c for c in got.columns if c in ("doc_id", "n_words", "n_removed", "class_id", "n_links", "start", "size", "target", "fingerprint", "base_failed", "lang_pred")]
    assert plain_rows(got, ids) == plain_rows(plain, ids)
    if operator is not suffix.repeated_spans:
        assert got.count() == len(SOME)


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__name__)
def test_stages_carry_columns_named_as_their_own(spark, stage):
    docs = with_own_names(spark)
    got = stage(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    assert rows and all(r["row_id"] is None and r["id"] == 0 for r in rows)


def test_packing_carries_nothing_but_pieces(spark):
    got = packing.pack_documents(with_own_names(spark), vocabulary()).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in SOME}
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for (s, at, n), (t, after, _) in zip(places, places[1:]):
        assert after == at + n if s == t else after == 0


def test_null_rows_of_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, id long, rendered string, n_turns string, key long"
    rows = [(1, 0, "user", None, 9, "r", "t", 1), (1, None, None, "x", 9, "r", "t", 1), (None, 0, "assistant", "y" * 200_000, 9, None, None, None), (None, None, None, None, None, None, None, None), (1, 0, "user", None, 9, "r", "t", 1)]
    for some in (rows, []):
        got = {r["conv_id"]: r for r in chat.read_back(chat.render(spark.createDataFrame(some, schema))).collect()}
        assert {k: r["n_turns"] for k, r in got.items()} == ({1: 3, None: 2} if some else {})
    assert chat.read_back(chat.render(spark.createDataFrame(rows, schema))).where("conv_id IS NULL").first()["loss_chars"] == 200_000


def test_null_rows_of_pages(spark):
    schema = "page_id long, url string, html string, payload_digest string, archive string, n long, record_type string"
    big = "<p>" + "z" * 200_000
    rows = [(1, None, None, "d", "a", 1, "t"), (2, "http://a/ b%20\r\nX: y", big, None, None, None, None), (3, "u", big, "d", "a", 1, "t"), (None, "u", big, "d", "a", 1, "t"), (None, None, None, None, None, None, None), (3, "u", big, "d", "a", 1, "t"), (4, "u", "", "d", "a", 1, "t")]
    got = warc.archived(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    large = [r for r in got if r["payload_bytes"] > 100]
    assert [r["page_id"] for r in large if r["record_type"] == "response"] == [2]
    assert all(r["refers_to"] == 2 for r in large if r["record_type"] == "revisit") and sum(r["record_type"] == "revisit" for r in large) == 3
    assert warc.archived(spark.createDataFrame([], schema)).count() == 0
