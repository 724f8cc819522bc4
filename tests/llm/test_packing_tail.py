"""Sources that share a queue keep their proportions, and the weights given for them."""

import pandas as pd
import pytest
from public_tokenizers import path

from hornfels.llm import packing


@pytest.mark.parametrize("weights", [None, {"s0": 1.0, "s1": 1.0, "s2": 4.0, "s3": 2.0, "s4": 1.0, "n": 1.0}])
def test_tail_sources_in_every_window(spark, monkeypatch, weights):
    monkeypatch.setattr(packing, "QUEUES", 2)
    monkeypatch.setattr(packing, "SHARED", 2)
    size = {"0": 100, "1": 90, "2": 60, "3": 50, "4": 40, None: 30}
    rows = [(f"{s}-{k}", " ".join(["and of the to"] * 30), s) for s, n in size.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(3)
    length = 500
    got = packing.pack(docs, "doc_id", path=path("word_bpe_49k.json"), weights=weights, length=length).toPandas()
    for _, g in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        assert g["length"].sum() == g["doc_tokens"].iloc[0] and (g["start"].iloc[1:].to_numpy() == (g["start"] + g["length"]).iloc[:-1].to_numpy()).all()
    places = got.sort_values(["sequence_id", "offset"])
    at = places["sequence_id"] * length + places["offset"]
    assert at.iloc[0] == 0 and (at.iloc[1:].to_numpy() == (at + places["length"]).iloc[:-1].to_numpy()).all()
    source = got["doc_id"].str.split("-").str[0]
    mix = pd.crosstab(got["sequence_id"], source, got["length"], aggfunc="sum").fillna(0)
    per = {s: n / sum(size.values()) for s, n in size.items()} if weights is None else {s: weights["n" if s is None else f"s{s}"] / 10 for s in size}
    full = mix.iloc[: (len(mix) - 1 if weights is None else 20)]
    for s, share in per.items():
        assert (full[str(s)] - share * length).abs().max() <= 4
