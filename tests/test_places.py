"""Place names are found by joins, inside words and across pieces, whatever the size of the gazetteer."""

import random

from roadlens.operators.news import TEXT_PIECE, extract_locations, find_names


def brute(texts, names):
    low = sorted({n.lower() for n in names if n}, key=lambda n: (-len(n), n))
    return {i: [n for n in low if n in t.lower()] for i, t in texts if t and any(n in t.lower() for n in low)}


def found(spark, texts, names):
    t = spark.createDataFrame(texts, "id long, txt string")
    g = spark.createDataFrame([(n,) for n in names], "name string")
    return {r.id: r.names for r in find_names(t, "txt", "id", g).collect()}


def test_names_of_all_lengths_match_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abc\u0111 ") for _ in range(rng.randint(1, 14)))
    names = [word() for _ in range(300)] + ["A", "phường một", "Phường Một B", "", None]
    texts = [(i, "".join(rng.choice("abcAB\u0111\U0001f600 \n") for _ in range(rng.choice([0, 1, 5, 40, 3 * TEXT_PIECE])))) for i in range(60)]
    texts += [(100, None), (101, "x" * (TEXT_PIECE - 4) + "PHƯỜNG MỘT bc"), (102, "phường mộ")]
    assert found(spark, texts, names) == brute(texts, [n for n in names if n])


def test_a_name_longer_than_a_piece_and_an_empty_gazetteer(spark):
    long = "z" + "yx" * TEXT_PIECE
    texts = [(1, "q" * 700 + long + "q" * 700), (2, long[:-1]), (3, "z")]
    assert found(spark, texts, [long, "z"]) == brute(texts, [long, "z"])
    assert found(spark, texts, []) == {}


def test_a_gazetteer_of_a_million_names(spark):
    gaz = spark.range(1_000_000).selectExpr("concat('Street ', id, '.') AS name")
    texts = spark.createDataFrame([(i, f"crash on street {i * 999}. and downstreet 7. again") for i in range(50)], "id long, txt string")
    got = {r.id: r.names for r in find_names(texts, "txt", "id", gaz).collect()}
    assert got == {i: sorted({f"street {i * 999}.", "street 7."}, key=lambda n: (-len(n), n)) for i in range(50)}


def test_every_row_stays_and_the_city_is_appended(spark):
    rows = spark.createDataFrame([(1, "In Hue", "hue"), (1, "In Hue", "hanoi"), (None, None, "hanoi"), (2, "none", None)], "id long, txt string, city string")
    g = spark.createDataFrame([("HUE",)], "name string")
    got = sorted((r.txt or "", r.city or "", r.locations) for r in extract_locations(rows, "txt", g, "city").collect())
    assert got == [("", "hanoi", ["hanoi"]), ("In Hue", "hanoi", ["hue", "hanoi"]), ("In Hue", "hue", ["hue"]), ("none", "", [])]


def test_only_places_where_a_name_may_begin_become_rows(spark):
    from pyspark.sql import functions as F

    from roadlens.operators import news

    names = spark.createDataFrame([("peru",), ("viet nam",)], "_name string")
    heads = names.select(F.substring("_name", 1, news.NAME_HEAD).alias("_head"))
    pieces = spark.createDataFrame([(i, "no place but viet nam here " * 20) for i in range(50)], "_id long, _piece string")
    at = pieces.mapInArrow(news._name_places(news._head_bitmap(heads, [4, 6]), [4, 6], 512, 8), "_id long, _window string, _head string").collect()
    assert len(at) < 1.1 * 50 * 19 and sum(r._window == "viet nam" and r._head == "viet n" for r in at) == 50 * 19


def test_a_full_bitmap_of_heads_changes_no_result(spark, monkeypatch):
    from roadlens.operators import news

    texts, names = [(1, "ab cd abc"), (2, "xyz" * 400), (None, "abc")], ["ab", "abc", "zx", "c"]
    want = found(spark, texts, names)
    assert want[1] == ["abc", "ab", "c"] and want[2] == ["zx"]
    monkeypatch.setattr(news, "_head_bitmap", lambda heads, sizes: spark.sparkContext.broadcast(news.np.full(news.HEAD_BITS >> 6, 2**64 - 1, "uint64")))
    assert found(spark, texts, names) == want
