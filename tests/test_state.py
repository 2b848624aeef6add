from parcelwright.operators import state


def test_upserts_links_and_trails(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "k long, v string, at int")
    changes = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1), (1, "old", 0)], "k long, v string, at int")
    assert {(r.k, r.v) for r in state.upserted(now, changes, ["k"], ["at"]).collect()} == {(1, "a"), (2, "d"), (3, "e"), (None, "n")}
    links = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), ("z", 2)], "a string, b int")
    assert {tuple(r) for r in state.new_links(links.where("a = 'z'"), links, ["a", "b"]).collect()} == {("x", 1), ("y", None)}
    assert state.new_links(links, links.limit(0), ["a", "b"]).collect() == []
    trail = state.trail(changes, ["k"], ["at"], ["v"]).where("k = 2").collect()[0].trail
    assert [(t["at"], t["v"]) for t in trail] == [(2, "c"), (3, "d")]


def test_one_table_of_several_and_evidence(spark):
    one, other = spark.createDataFrame([(1, "s")], "id int, name string"), spark.createDataFrame([(2.0,)], "area double")
    rows = {r.origin: r for r in state.unified({"one": one, "other": other}, {"id": "long", "name": "string", "area": "double"}).collect()}
    assert rows["one"].id == 1 and rows["one"].area is None and rows["other"].area == 2.0 and rows["other"].name is None
    got = {r.id: r for r in state.with_evidence(spark.createDataFrame([(1,), (2,)], "id int"), "id", {"a": one, "b": spark.createDataFrame([(1, 5), (2, 6)], "id int, n int")}).collect()}
    assert got[1].sources == 2 and got[1].a.name == "s" and got[2].a is None and got[2].b.n == 6 and got[2].sources == 1
