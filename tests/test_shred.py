import json

from hypothesis import given, settings
from hypothesis import strategies as st

from marlinspike.operators.shred import FLEET, adjacency_rows, certificates, entity, shred


def _found(spark, payloads):
    raw = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads, 1)] + [(None, "{}", "x")], "id long, payload string, node string")
    return sorted(tuple(r) for r in certificates(raw).collect())


def test_layouts_of_one_posting(spark):
    payloads = [
        json.dumps({"vessels": [{"rotations": [{"positions": [{"certificates": [{"code": "A"}, None, "B", {"valid_months": 3}]}]}]}]}),
        json.dumps({"data": [{"fleet": {"legs": {"openings": {"rank": "x", "certs": "C"}}}}]}),
        json.dumps({"posting": {"vessels": json.dumps([{"rotations": [None, {"positions": {"b2": {"rank": "r", "certs": json.dumps(["D"])}, "a1": {"certificates": "[]"}}}]}])}}),
        '{"vessels": [{"rotations": [{"positions": [{"certificates": [{"code": "A"}',
        None,
        "",
        "[]",
        "<item/>",
        json.dumps({"certificates": ["Z"], "vessels": [{"certificates": ["Z"]}]}),
        json.dumps({"vessels": None}),
    ]
    assert _found(spark, payloads) == [(1, 1, 1, 1, 1, "A"), (1, 1, 1, 1, 3, "B"), (2, 1, 1, 1, 1, "C"), (3, 1, 2, 1, 1, "D")]


def test_delivered_twice_counts_once(spark):
    p = json.dumps({"vessels": [{"rotations": [{"positions": [{"certificates": ["A", "A"]}]}]}]})
    raw = spark.createDataFrame([(1, p), (1, p)], "id long, payload string")
    assert sorted(tuple(r) for r in certificates(raw).collect()) == [(1, 1, 1, 1, 1, "A"), (1, 1, 1, 1, 2, "A")]


def test_parent_links_and_fields(spark):
    p = json.dumps({"vessels": [{"name": "V", "rotations": [{"embark": "E", "weeks": {"on": 3}, "positions": [{"rank": "R", "pay": {"min": 5}}]}]}]})
    raw = spark.createDataFrame([(1, p)], "id long, payload string")
    adj = shred(raw)
    vessel, rotation = entity(adj, "vessel", {"name": "name"}).first(), entity(adj, "rotation", {"on": "weeks.on"}).first()
    position = entity(adj, "position", {"rank": "rank", "pay_min": "pay.min"}).first()
    assert (vessel["name"], rotation["on"], position["rank"], position["pay_min"]) == ("V", "3", "R", "5")
    q = json.dumps({"vessels": [{"tags": ["b", "a", "b"], "name": "V"}, {"tags": "solo"}, {"name": "W"}]})
    tags = entity(shred(spark.createDataFrame([(1, q), (1, q)], "id long, payload string")), "vessel", {"tags": "tags[]", "last": "tags"}).orderBy("vessel_no").collect()
    assert [(r.tags, r.last) for r in tags] == [(["b", "a", "b"], "b"), (["solo"], "solo"), (None, None)]
    assert rotation["parent"] == vessel["node"] and position["parent"] == rotation["node"] and vessel["parent"] == 0


def test_very_deep_and_long_payloads_do_not_break():
    assert adjacency_rows(1, "[" * 100_000, FLEET) == []
    assert adjacency_rows(1, "[" * 5000 + "]" * 5000, FLEET) == []
    assert len(adjacency_rows(1, json.dumps({"a": ["x" * 100_000] * 3}), FLEET)) == 3


_json = st.recursive(st.none() | st.text(max_size=4) | st.integers(), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["vessels", "rotations", "positions", "certs", "code", "name", "k"]), c, max_size=3), max_leaves=20)


def _brute(v):
    """Certificates by walking the levels directly."""
    labels = [("vessels", "fleet"), ("rotations", "legs"), ("positions", "openings"), ("certificates", "certs")]

    def items(x):
        if isinstance(x, str) and x.lstrip()[:1] in ("[", "{"):
            try:
                x = json.loads(x)
            except ValueError:
                pass
        if isinstance(x, list):
            return x
        if isinstance(x, dict) and x and not FLEET.fields & x.keys() and all(y is None or isinstance(y, dict) for y in x.values()):
            return list(x.values())
        return [] if x is None else [x]

    out = []

    def walk(o, depth, path):
        if isinstance(o, list):
            for x in o:
                walk(x, depth, path)
        elif isinstance(o, dict):
            n = 0
            for k, x in o.items():
                if depth < 4 and k in labels[depth]:
                    for item in items(x):
                        n += 1
                        if depth == 3:
                            code = item.get("code") if isinstance(item, dict) else item
                            if code is not None and not isinstance(code, (list, dict)):
                                out.append((*path, n, code if isinstance(code, str) else json.dumps(code)))
                        elif isinstance(item, dict):
                            walk(item, depth + 1, (*path, n))
                elif isinstance(x, (dict, list)):
                    walk(x, depth, path)

    walk(v, 0, ())
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(_json)
def test_any_document_against_a_direct_walk(v):
    rows = adjacency_rows(1, json.dumps(v), FLEET)
    nodes = {r[1]: r for r in rows if r[3] == "certificate"}
    got = sorted((*nodes[r[2]][6], r[7]) for r in rows if r[3] is None and r[4] == "code" and r[2] in nodes)
    assert got == _brute(v) if isinstance(v, (dict, list)) else rows == []
