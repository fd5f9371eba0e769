"""Columns of a caller that are named like an operator's own change nothing."""

from __future__ import annotations

from dossierlake.llm import decontam, exact, minhash, packing, pii, substring, tokens, toxicity


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_operators_read_id_and_text_alone(spark, clashing):
    plain = clashing.select("doc_id", "text").coalesce(2)
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    net = toxicity.Network.new(1)
    for run in (
        lambda x: pii.find_spans(x).drop("removed"),
        tokens.with_token_counts,
        lambda x: substring.remove_repeats(x, 4, 2),
        lambda x: toxicity.score(x, net),
        lambda x: decontam.contamination(x, items),
        lambda x: minhash.near_classes(x),
        lambda x: exact.exact_groups(x),
        lambda x: packing.pack(x, 256).groupBy("doc_id").sum("length"),
    ):
        assert same(run(clashing), run(plain))
