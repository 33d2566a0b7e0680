"""The models of secret scans against tokens that stand many times."""

import random

from attrilake.llm import secret_scan


def test_a_copied_key_does_not_vouch_for_itself(spark):
    rng = random.Random(4)
    key, other = ("".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789", k=40)) for _ in range(2))
    plain = ["getUserAccountSettings", "http_response_status_code", "thisisalongordinaryword", "readNextRecordFromStream", "maximum_number_of_retries", "connectionTimeoutSeconds"]
    rows = [(i, f"the key {key} of row {i} {plain[i % 6]}") for i in range(3000)] + [(3000 + i, f"{plain[i % 6]} and {plain[(i + 1) % 6]}") for i in range(60)] + [(4000, f"one {other}")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows) and got.pop(4000) == [("random", 4, 44)]
    assert all(s == ([("random", 8, 48)] if d < 3000 else []) for d, s in got.items())


def test_recall_of_injected_keys(spark):
    """Random keys of 16 to 64 characters are found, and identifiers aren't."""
    rng = random.Random(5)
    parts = "get set user account name list read write next record from stream data table column index key value type open close buffer size count parse format token error handler connection manager service request response status code time zone file path".split()
    join = [lambda w: "_".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "-".join(w), lambda w: "".join(w) + str(rng.randrange(100))]
    names = [rng.choice(join)(rng.choices(parts, k=rng.randrange(3, 6))) for _ in range(2500)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = {n: ["".join(rng.choices(letters, k=n)) for _ in range(10)] for n in (8, 12, 16, 24, 40, 64)}
    rows = [(i, f"call {names[i]} with {names[(7 * i) % 2500]}") for i in range(2500)]
    rows += [(2600 + i, f"password = {''.join(rng.choices(letters, k=24))}") for i in range(40)]
    at = {3000 + 100 * n + i: (n, k) for n, ks in keys.items() for i, k in enumerate(ks)}
    rows += [(d, f"it is {k} there") for d, (_, k) in at.items()]
    got = {r.doc_id: [s for s in r.spans if s.kind == "random"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {n: sum(bool(got[d]) for d, (m, _) in at.items() if m == n) / 10 for n in keys}
    assert all(recall[n] >= 0.9 for n in (16, 24, 40, 64)) and recall[12] >= 0.5, recall
    assert sum(len(got[i]) for i in range(2500)) <= 5
    assert all((s.start, s.end) == (6, 6 + len(at[d][1])) for d in at for s in got[d])
