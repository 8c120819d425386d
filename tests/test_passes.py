"""Quantiles by passes, names by an index, answers with estimates, series with gaps."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from parcelforge.operators import openstats, policy, quantiles

WANTED = [("q10", 0.1), ("q50", 0.5), ("q80", 0.8), ("q100", 1.0)]


def values(n=4000):
    rng = random.Random(4)
    spread = [lambda: rng.lognormvariate(0, 40), lambda: -rng.lognormvariate(0, 40), lambda: float(rng.randint(0, 5)), lambda: 1e9 + rng.random(), lambda: 5.0, lambda: 0.0]
    rows = [("hot", k % 2 or None, rng.choice(spread[:2])()) for k in range(n)] + [(g, 1, spread[i % 6]()) for i, g in enumerate("abcdefgh" * 40)]
    return [*rows, ("same", None, 7.0), *[("same", None, 7.0)] * 900, ("one", 1, 3.5), ("none", 1, None), (None, None, 2.0), (None, None, 4.0)]


@pytest.mark.parametrize(("held", "ranges"), [(10_000, 512), (20, 4), (1, 2)])
def test_quantiles_equal_percentiles(spark, tmp_path, held, ranges):
    df = spark.createDataFrame([(*r, 1) for r in values(4000 if held > 1 else 300)], "city string, n int, price double, v_ int").repartition(6)
    got = quantiles.exact_quantiles(df.withColumnRenamed("n", "rooms"), ["city", "rooms"], "price", WANTED, str(tmp_path), held, ranges)
    want = df.where("price is not null").groupBy("city", "n").agg(F.count(F.lit(1)), *[F.percentile("price", F.lit(q)) for _, q in WANTED])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert len(list(tmp_path.iterdir())) == 1  # the result alone is left


def test_no_group_is_held(spark, tmp_path):
    """Of a group with most rows, tasks give out counts and the few values of a range."""
    df = spark.range(200_000).select(F.when(F.col("id") % 100 > 0, "hot").otherwise("cold").alias("g"), (F.xxhash64("id") % 1_000_000 / 7).alias("v"))
    df.repartition(8).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    seen = {s.stageId() for s in stages(spark)}
    quantiles.exact_quantiles(rows, ["g"], "v", WANTED, str(tmp_path / "work"), held=500).collect()
    read = [s.shuffleReadRecords() for s in stages(spark) if s.stageId() not in seen]
    assert read and max(read) < 20_000


def stages(spark):
    jvm, context = spark.sparkContext._gateway.jvm, spark.sparkContext
    listed = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [listed.apply(k) for k in range(listed.size())]


PLACES = ["Konak", "Yeni Konak", "Konak Yolu", "Ala", "Alaca", "A", "Yeni", "yenikonak", "Ko", "", "Bağ", "Bağlar", "Mahalle 12", "Mahalle 123"]


def plain_names(targets, candidates):
    def fold(x):
        x = x.lower().translate(str.maketrans("ığüşöç", "igusoc"))
        return " ".join(w for w in x.split() if w not in openstats.PLACE_WORDS)

    out = []
    for t, parent, name in targets:
        key, squeezed = fold(name), fold(name).replace(" ", "")
        listed = sorted((o, i, fold(n)) for i, p, n, o in candidates if p == parent)
        rules = (lambda k: k == key, lambda k: k.replace(" ", "") == squeezed, lambda k: key in k, lambda k: k in key)
        hit = next(((i, tier) for tier, rule in enumerate(rules, 1) for _, i, k in listed if rule(k)), None)
        if key and hit:
            out.append((t, *hit))
    return sorted(out)


def test_names_equal_a_search_through_all(spark):
    rng = random.Random(2)
    candidates = [(k, f"p{rng.randint(0, 3)}", rng.choice(PLACES), rng.randint(0, 5)) for k in range(60)] + [(99, "p9", "Konak", 1)]
    targets = [(k, f"p{rng.randint(0, 4)}", rng.choice(PLACES) + rng.choice(["", " Yolu", " mah", "x", " Ko"])) for k in range(300)]
    got = openstats.resolve_names(spark.createDataFrame(targets, "target_id int, parent string, name string"), spark.createDataFrame(candidates, "candidate_id int, parent string, name string, ord int"))
    assert sorted(map(tuple, got.collect())) == plain_names(targets, candidates)


def test_names_of_a_large_parent_meet_few(spark):
    """With 100,000 candidates of one parent, the names that are compared are some for each that is found."""
    candidates = spark.range(100_000).select(F.col("id").alias("candidate_id"), F.lit("p").alias("parent"), F.concat(F.lit("Yeni Sokak "), F.col("id")).alias("name"), F.col("id").alias("ord"))
    inner = candidates.where("candidate_id % 1000 = 7").select("parent", F.concat(F.lit("sokak "), F.col("candidate_id")).alias("key_"))
    outer = candidates.select("parent", F.concat(F.lit("yeni sokak "), F.col("candidate_id")).alias("key_"))
    found = openstats.containing(inner, outer)
    assert found.select("inner_").distinct().count() == 100
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        found.explain()
    assert "Cartesian" not in out.getvalue() and "NestedLoop" not in out.getvalue()
    assert found.where("not contains(outer_, inner_)").count() == 0


def test_answers_that_lack_some(spark):
    rows = spark.createDataFrame([(1, '{"minPrice": 1}', 50.0), (2, "", None), (3, '{"assumptions": ["MANUEL EMSAL GİRİLMEDİĞİ için fiyat aralığı Türkiye geneli varsayılan konut lokasyonu için düşük güvenli ön tahmin olarak hesaplanmıştır."], "confidence": 0}', 80.5)], "id int, answer string, subject_area double")
    none = {k: F.lit(None).cast(t) for k, t in {"subject_building_age": "int", "floor_no": "int", "building_floors": "int", "address": "string"}.items()}
    rows = policy.fallback_estimate(policy.location_hint(policy.normalize_price_index(rows.withColumns(none), "answer", "subject_area")))
    got = policy.with_projections(policy.apply_fallback(rows)).orderBy("id").collect()
    assert [(r.estimated, r.min_price, r.avg_price, r.confidence) for r in got] == [(True, 0.0, 1664000.0, 0.35), (False, None, None, None), (True, 2164000.0, 2576000.0, 0.35)]
    assert [len(r.assumptions) for r in got] == [1, 0, 1] and got[0].missing_data == ["Manuel emsal verisi"]
    assert "80.5 m² büyüklüğü" in got[2].market_projection.summary and "Alan büyüklüğü" in got[1].market_projection.summary


def test_numbers_and_texts_of_answers(spark):
    text = 'x {"avgPrice": "1.250,5 TL", "minPrice": 1.5, "maxPrice": "2.000", "confidence": "yok", "expectedSaleDays": [1], "comps": [{"price": "1.5", "netArea": 1.5, "title": " a "}, 7, {"price": true}], "rationale": 12, "assumptions": "no", "missingData": [1, " b "]} y'
    (r,) = policy.normalize_price_index(spark.createDataFrame([(text, None), ], "answer string, area double"), "answer", "area").collect()
    assert (r.avg_price, r.min_price, r.max_price, r.confidence, r.expected_sale_days, r.rationale) == (1000.0, 0.0, 2000.0, 0.0, None, "12")
    assert [(x.price, x.netArea, x.title) for x in r.comps if x] [0] == (15.0, 1.5, "a") and len(r.comps) == 3 and r.assumptions == [] and r.missing_data == ["1", "b"]
    for odd in ("", None, "{", "{}", "[1]", '{"comps": null}', '{"marketProjection": 5}'):
        (r,) = policy.normalize_price_index(spark.createDataFrame([(odd, 1.0)], "answer string, area double"), "answer", "area").collect()
        assert r.avg_price is None and r.comps == [] and r.market_projection is None


def test_gaps_by_the_calendar(spark):
    rows = spark.createDataFrame([("s", 1, 100.0), ("s", 2, 110.0), ("s", 14, 121.0), ("s", 16, 50.0), ("t", 5, 1.0)], "series string, idx int, value double")
    got = {r.series: r for r in openstats.index_changes(rows, by_calendar=True).collect()}
    assert (got["s"].latest, got["s"].monthly, got["s"].annual, got["s"].period) == (50.0, None, None, -50.0) and got["t"].period == 0.0
    assert [(r.idx, r.change_pct) for r in openstats.yearly_changes(rows, by_calendar=True).collect()] == [(14, 10.0)]
    assert openstats.index_changes(rows).where("series = 's'").first().monthly == pytest.approx((50 - 121) / 121 * 100)
    filled = openstats.monthly(rows).where("series = 's'").orderBy("idx").collect()
    assert [r.idx for r in filled] == list(range(1, 17)) and [r.value for r in filled if r.value is not None] == [100.0, 110.0, 121.0, 50.0]
