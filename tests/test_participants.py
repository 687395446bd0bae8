"""Trees by pointer doubling, builds that go on where they stopped, and the participants' build in its three modes."""

import pytest

from lattiq.operators import etl, participants, trees
from lattiq.sources import readers
from lattiq.sources.written import Build

NODE = "id long, name string, parent long"


def test_long_chain_cycles_and_orphans(spark):
    """A chain of 1,000 nodes, a cycle of three with a tail below it, a node above itself, and a line that ends at a missing parent."""
    chain = [(1, "root", None)] + [(k, f"n{k}", k - 1) for k in range(2, 1001)]
    loops = [(2001, "a", 2003), (2002, "b", 2001), (2003, "c", 2002), (2004, "tail", 2001), (2005, "tail", 2004), (4001, "own", 4001), (4002, "x", 4001)]
    orphans = [(3001, "o", 9999), (3002, "p", 3001)]
    nodes = spark.createDataFrame(chain + loops + orphans, NODE)
    walked = {r.id: r for r in trees.walk(nodes).collect()}
    assert set(walked) == set(range(1, 1001))
    assert all(walked[k].depth == k - 1 and walked[k].path == list(range(1, k + 1)) and walked[k].child_count == (k < 1000) for k in (1, 2, 3, 512, 513, 1000))
    assert {r.id: r.fault for r in trees.faults(nodes).collect()} == {k: "cycle" for k, _, _ in loops} | {3001: "orphan", 3002: "orphan"}


def test_wide_tree_and_nothing(spark):
    nodes = spark.createDataFrame([(1, "r", None), (50, "s", None)] + [(k, "n", 1 if k < 20 else k - 10) for k in range(2, 40)], NODE)
    walked = {r.id: (r.depth, r.path) for r in trees.walk(nodes).collect()}
    assert walked[1] == (0, [1]) and walked[50] == (0, [50]) and walked[5] == (1, [1, 5]) and walked[39] == (3, [1, 19, 29, 39])
    assert trees.walk(spark.createDataFrame([], NODE)).count() == 0 and trees.faults(nodes).count() == 0


def test_build_goes_on(spark, tmp_path):
    """A build that breaks off in its third table makes the first two no more; other inputs make all anew."""
    calls = []

    def run(inputs, broken):
        build = Build(spark, str(tmp_path / "build"), inputs)

        def make(name, df):
            def made():
                calls.append(name)
                if name == broken:
                    raise RuntimeError(name)
                return df()

            return build.table(name, made)

        one = make("one", lambda: spark.range(5))
        two = make("two", lambda: one.selectExpr("id * 2 AS id"))
        three = make("three", lambda: two.where("id > 2"))
        return [r.id for r in three.orderBy("id").collect()], build

    with pytest.raises(RuntimeError):
        run("v1", "three")
    assert calls == ["one", "two", "three"]
    calls.clear()
    found, build = run("v1", None)
    assert found == [4, 6, 8] and calls == ["three"] and build.made == ["three"]
    assert {k: n for k, (_, n) in build.records().items()} == {"one": 5, "two": 5, "three": 3}
    calls.clear()
    assert run("v1", None)[0] == [4, 6, 8] and calls == []
    assert run("v2", None)[0] == [4, 6, 8] and calls == ["one", "two", "three"]


TREE = [(1, "Sport", None), (2, "Land", 1), (3, "League", 2), (4, "Cup", 2), (5, "Other", 1), (6, "Other League", 5), (7, "International Tournaments", 1), (8, "World Cup", 7), (9, "Club Friendly", 2), (10, "Specials", 1)]


def feed_of(spark, rows, page=0):
    names = lambda x: [{"locale": "en_GB", "name": x}] if x else []
    each = [(i, kind, names(name), nodes, None if members is None else [(m, k, names(n), g) for m, k, n, g in members]) for i, kind, name, nodes, members in rows]
    return spark.createDataFrame([(page, each)], f"page long, {readers.FEED}")


def build_of(spark, tmp_path, feed, **more):
    return participants.prepare(Build(spark, str(tmp_path / "p")), feed, spark.createDataFrame(TREE, NODE), **more)


def test_team_sport(spark, tmp_path):
    person = lambda i, name, nodes=(1, 2, 3): (i, "PARTICIPANT", name, list(nodes))
    first = [
        (100, "TEAM", "Reds", [1, 2, 3, 6, 10], [person(1, "Doe, Jo (USA)"), person(2, "Reds #12"), person(3, "X"), (4, "LABEL", "Reds Extra Time", [1])]),
        (101, "TEAM", "Reds", [1, 2, 4, 3], [person(5, "Ann  Lee"), person(6, "Ann Lee"), person(7, "Ann Lee", (1, 4))]),
        (102, "TEAM", "Land", [1, 8], [person(1, "Someone Else", (1, 8, 5))]),
    ]
    second = [
        (100, "TEAM", "Listed again", [1], [person(99, "Not Read")]),
        (103, "TEAM", "Friends", [1, 2, 9], [person(8, "Kim Po")]),
        (104, "TEAM", "Nothing", [1, 77], [person(9, "Kim Pa")]),
        (105, "TEAM", "Empty", [1, 3], []),
        (106, "TEAM", "Ghosts", [1, 5, 6], [person(10, "Ghost Penalties")]),
        (1000011657, "TEAM", "Rugby", [1, 3], [person(11, "Big One")]),
        (12, "PARTICIPANT", "Alone", [1, 3], None),
    ]
    tables = build_of(spark, tmp_path, feed_of(spark, second, 1).unionByName(feed_of(spark, first, 0)))
    clubs = {r.id: (r.name, r.competition_ids, r.group_ids, r.removed_by) for r in tables["clubs"].collect()}
    assert clubs == {
        100: ("Reds", [3, 4, 6], [1, 2], None),
        101: ("Reds", [3, 4], [1, 2], "double club"),
        102: ("Land", [8], [1, 2], "no players"),
        103: ("Friends", [9], [1, 2], "friendlies only"),
        104: ("Nothing", [], [1], "no competition"),
        106: ("Ghosts", [6], [1, 5], "no players"),
        1000011657: ("Rugby", [3], [1], "other sport"),
    }
    players = {r.id: (r.name, r.club_id, r.competition_ids, r.group_ids, r.removed_by) for r in tables["players"].collect()}
    assert players[1] == ("Jo Doe", 100, [3, 8], [1, 2], None)
    assert {k: v[4] for k, v in players.items()} == {1: None, 2: "placeholder", 3: "no name of a person", 5: "club removed", 6: "club removed", 7: "club removed", 8: "club removed", 9: "club removed", 10: "no name of a person", 11: "club removed"}
    counts = [(r.rule, r.clubs, r.players) for r in tables["counts"].orderBy("step").collect()]
    assert counts[0] == ("read", 7, 10) and counts[-1] == ("no players", 1, 1) and [c[1] for c in counts] == [7, 6, 5, 4, 3, 3, 3, 3, 3, 1]


def test_league_and_individuals(spark, tmp_path):
    rows = [(100, "TEAM", "Blues", [1, 2, 5, 3, 6], [(1, "PARTICIPANT", "Jo Doe", [1, 2, 5, 6]), (2, "PARTICIPANT", "Jo Doe", [3])])]
    league = build_of(spark, tmp_path / "league", feed_of(spark, rows), league_id=6)
    assert [(r.id, r.competition_ids, r.group_ids) for r in league["clubs"].collect()] == [(100, [3, 6], [1, 5])]
    assert {r.id: (r.competition_ids, r.group_ids, r.removed_by) for r in league["players"].collect()} == {1: ([3, 6], [1, 5], None), 2: ([3], [], "double player")}
    alone = [(1, "PARTICIPANT", "Doe, Jo", [1, 2, 3, 10], None), (2, "PARTICIPANT", "x", [3], None), (1, "PARTICIPANT", "Doe, Jim", [5, 6], None), (100, "TEAM", "Land", [1, 2, 8], None)]
    tennis = build_of(spark, tmp_path / "alone", feed_of(spark, alone), individual=True)
    assert {r.id: (r.name, r.club_id, r.competition_ids, r.group_ids, r.removed_by) for r in tennis["players"].collect()} == {1: ("Jim Doe", None, [5, 6], [], None), 2: ("x", None, [3], [], "no name of a person")}
    assert [(r.id, r.competition_ids, r.removed_by) for r in tennis["clubs"].collect()] == [(100, [2, 8], None)]


def test_home_country_ties_and_kinds(spark):
    nodes = etl.classify(trees.walk(spark.createDataFrame(TREE + [(11, "Marcatore", 1), (12, "Below", 11), (13, "Deep", 12), (14, "Winners", 10), (15, "Testing", 2), (16, "League Two", 3)], NODE)))
    kinds = {r.id: r.kind for r in nodes.collect()}
    assert kinds == {1: "group", 2: "group", 3: "competition", 4: "competition", 5: "group", 6: "competition", 7: "group", 8: "competition", 9: "competition", 10: "market", 11: "market", 12: "market", 13: "market", 14: "competition", 15: "market", 16: "competition"}
    members = spark.createDataFrame([(1, 6, 0), (1, 3, 1), (2, 8, 0), (3, 3, 0), (3, 6, 1), (3, 6, 2), (4, 16, 5)], "id long, competition_id long, ord int")
    assert {r.id: r.country for r in etl.home_country(members, nodes).collect()} == {1: 5, 3: 5, 4: 2}
