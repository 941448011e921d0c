"""Damaged stores are refused, and training does not depend on the order of rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, gam, html, quality, queries, simhash, store
from gridloom.llm.common import flat

LOREM = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix blue potions near an old stone bridge"


def copy_with(spark, path, name, change):
    """A copy of a store whose chunk rows went through ``change``."""
    out = f"{path}-{name}"
    chunks = spark.read.parquet(f"{path}/chunks")
    change(chunks).write.partitionBy("kind").parquet(f"{out}/chunks")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{out}/{part}")
    return out


def test_read_ids_refuses_damaged_chunks(spark, monkeypatch):
    monkeypatch.setattr(store, "LOOKED_AT", 1.0)
    docs = spark.createDataFrame([(k, " ".join([f"{LOREM} {k % 5} {j}" for j in range(200)])) for k in range(300)], "doc_id long, text string")
    path = store.write_store(docs, queries.vocabulary())
    whole = {r["doc_id"]: r["token_ids"] for r in store.read_ids(spark, path).collect()}
    assert len(whole) == 300 and whole[5] != whole[6] and whole[7] == store.read_ids(spark, path).where("doc_id = 7").first()["token_ids"]
    chunks = spark.read.parquet(f"{path}/chunks").where("kind = 'chunk'")
    lost = chunks.orderBy("hash").first()["hash"]
    hit = F.coalesce(F.col("hash") == F.lit(bytes(lost)), F.lit(False)) & (F.col("kind") == "chunk")
    with pytest.raises(Exception, match="lacks a chunk"):
        store.read_ids(spark, copy_with(spark, path, "lost", lambda c: c.where(~hit))).collect()
    changed = F.when(hit, F.concat(F.substring("body", 1, 2), F.lit(b"\x01\x00"), F.expr("substring(body, 5, length(body))"))).otherwise(F.col("body"))
    with pytest.raises(Exception, match="do not fit its hash"):
        store.read_ids(spark, copy_with(spark, path, "changed", lambda c: c.withColumn("body", changed))).collect()


def test_training_takes_the_same_text_of_a_repeated_id(spark):
    rows = [(k % 40, " ".join([LOREM, str(k), "again " * (k % 7)] * (1 + k % 9)), "en") for k in range(80)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(40)], "doc_id long, quality int")
    schema = "doc_id long, text string, lang string"
    orders = [spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame(rows[::-1], schema).repartition(7)]
    samples = [sorted(map(tuple, quality.labelled_sample(d, labels, 100).collect())) for d in orders]
    assert samples[0] == samples[1] and len(samples[0]) == 40
    models = [gam.train(d, labels) for d in orders]
    texts = [r[1] for r in rows[:30]]
    scores = [m.score(gam.features(*flat(pa.array(texts)))).tolist() for m in models]
    assert scores[0] == scores[1]
    weights = [quality.train(d, labels) for d in orders]
    assert (weights[0] is None) == (weights[1] is None) and (weights[0] is None or (weights[0].weights == weights[1].weights).all())


def test_items_of_names_and_numbers_are_found_by_their_forms(spark):
    items = [(1, "Pay Ann 14 euros Bob 15 euros Carl 16 euros Dan 17 euros Eve 18 euros"), (2, "Ann 3 Bob 4 Carl 5 Dan 6 Eve 7 Fay 8 Gus 9"), (3, "Send Ann 3 kg and Bob 4 kg or Carl 5 kg of 7 Dan 8 cm Eve 9 cm Fay 2 cm")]
    docs = [
        (1, "Pay Tom 24 euros Jim 25 euros Kate 36 euros Sue 47 euros Pat 58 euros"),  # other names and numbers
        (2, "before it all. Pay Tom 24 euros Jim 25 euros Kate 36 euros Sue 47 euros Pat 58 euros and after it"),
        (3, "Pay Tom 24 euros Jim 25 dollars Kate 36 cents Sue 47 pounds Pat 58 kg"),  # the item says one unit five times
        (4, "Tom 24 euros Jim 25 euros Kate 36 euros Sue 47 euros Pat 58 euros"),  # a list without the item's word
        (5, "Pay Tom 24 euros Jim 25 euros Kate 36 euros"),  # half of it
        (6, "Zoe 13 Yan 14 Xav 15 Wim 16 Vic 17 Uma 18 Ted 19"),  # the second item tells nothing of itself
        (7, "Ann 3 Bob 4 Carl 5 Dan 6 Eve 7 Fay 8 Gus 9"),  # but word for word
        (8, "Send Tim 9 kg and Rob 8 kg or Max 7 kg of 6 Leo 5 cm Ida 4 cm Kim 3 cm"),
        (9, " ".join(["Pay Tom 24 euros Jim 25 dollars Kate 36 cents Sue 47 pounds Pat 58 kg."] * 40) + " Pay Ada 1 euros Ben 2 euros Cas 3 euros Dov 4 euros Eli 5 euros"),
    ]
    found = decontam.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 1), (7, 2), (8, 3), (9, 1)}


def test_simhash_largest_id(spark):
    """The largest id is an id: it comes back, and names the component of its text; rows without an id stay without."""
    most, text = (1 << 63) - 1, "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(most, text), (None, text), (None, "quite another text about other things"), (5, "and a third one that nothing resembles")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(most, most), (None, most), (None, None), (5, 5)}


def test_wrapper_does_not_depend_on_the_order_of_pages():
    """Pages of random structure, shuffled and with repeats, give one wrapper and the same texts."""
    rng = np.random.default_rng(9)
    part = lambda k: f"<{(t := str(rng.choice(['p', 'div', 'ul', 'section'])))}>{'<b>x</b>' * int(rng.integers(0, 3))}part {k} {rng.integers(0, 99)}</{t}>"
    pages = ["<html><body>" + "".join(part(k) for k in range(int(rng.integers(2, 9)))) + "<div>All rights reserved</div></body></html>" for _ in range(60)]
    first = html.infer(pages)
    for _ in range(3):
        again = html.infer([pages[k] for k in rng.permutation(60)] + pages[:4])
        assert again == first and [html.extract(p, again) for p in pages] == [html.extract(p, first) for p in pages]
