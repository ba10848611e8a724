"""Nested address ranges against a scan of all of them."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flintglass.operators import enrich, intervals


def test_keys(spark):
    texts = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "::", "::1", "2001:db8::", "2001:DB8:0:1::f", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", ":1::2", "12345::", "x", "", None, "1:2:3:4:5:6:7::", ":::", "1::2:3:4:5:6:7:8", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::"]
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", intervals.address_key(F.col("t")).alias("k")).collect()}
    for t in texts:
        try:
            a = ipaddress.ip_address(t)
            want = f"4{int(a):08x}" if a.version == 4 else f"6{int(a):032x}"
        except ValueError:
            want = None
        assert got[t] == want, t
    blocks = ["10.1.2.3/8", "10.0.0.0/13", "0.0.0.0/0", "1.2.3.4", "1.2.3.4/32", "::/0", "2001:db8::/33", "2001:db8::1", "1.2.3.4/33", "1.2.3.4/x", "x/8", None]
    got = {r.b: r.r for r in spark.createDataFrame([(t,) for t in blocks], "b string").select("b", intervals.block_range(F.col("b")).alias("r")).collect()}
    for b in blocks:
        try:
            n = ipaddress.ip_network(b, strict=False)
            form = "4%08x" if n.version == 4 else "6%032x"
            want = (form % int(n[0]), form % int(n[-1]), n.prefixlen)
        except ValueError:
            want = None
        assert (None if got[b] is None else tuple(got[b])) == want, b


def test_owners_of_nested_blocks(spark):
    rng = random.Random(7)
    four = [f"{rng.randrange(256)}.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}/{rng.randrange(2, 33)}" for _ in range(300)] + ["0.0.0.0/0"]
    six = [f"2001:db8:{rng.randrange(16):x}:{rng.randrange(4):x}::{rng.randrange(256):x}/{rng.randrange(16, 129)}" for _ in range(200)] + ["::/0", "2001:db8::/32"]
    chosen = {str(ipaddress.ip_network(b, strict=False)) for b in four + six}
    blocks = [(b, rng.choice([None, i]), f"o{i}") for i, b in enumerate(sorted(chosen - {"0.0.0.0/0"}))]
    given = [*blocks, ("no block", 1, "x"), (None, 1, "x")]
    points = [f"{rng.randrange(256)}.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)] + [f"2001:db8:{rng.randrange(16):x}:{rng.randrange(4):x}::{rng.randrange(256):x}" for _ in range(300)] + ["9.9.9.9", "9.9.9.9", "x", None, "fe80::1"]
    nets = [(ipaddress.ip_network(b), b, asn, owner) for b, asn, owner in blocks]
    want = []
    for p in points:
        try:
            a = ipaddress.ip_address(p)
            hit = max((n for n in nets if n[0].version == a.version and a in n[0]), key=lambda n: n[0].prefixlen, default=None)
        except ValueError:
            hit = None
        want.append((p, hit[1] if hit else "", str(hit[2]) if hit and hit[2] is not None else "", hit[3] if hit else ""))
    table = spark.createDataFrame(given, "block string, asn long, owner string").repartition(5)
    found = intervals.block_owners(spark.createDataFrame([(p,) for p in points], "ip string"), "ip", table)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    none = intervals.block_owners(spark.createDataFrame([("1.1.1.1",)], "ip string"), "ip", table.filter("1 = 0"))
    assert [tuple(r) for r in none.collect()] == [("1.1.1.1", "", "", "")]
    flat = intervals.flattened(table.select(intervals.block_range(F.col("block")).alias("r"), "owner").select("r.*", "owner"), ["owner"])
    keys = [r.key for r in flat.collect()]
    assert len(keys) == len(set(keys)) <= 2 * len(blocks)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_that_cross(spark, seed):
    """Any ranges, equal ones too: the longest prefix, then the one that begins first."""
    rng = random.Random(seed)
    ranges = []
    for i in range(150):
        first = rng.randrange(3_000)
        ranges.append((first, first + rng.randrange(-2, 400), rng.randrange(8), f"o{i}"))
    points = [(i, rng.randrange(3_500)) for i in range(400)] + [(999, None), (998, -1), (997, 2**32)]
    found = enrich.range_join(spark.createDataFrame(points, "id int, ip long"), spark.createDataFrame(ranges, "first_ip long, last_ip long, prefix_len int, owner string").repartition(6), "ip")
    for r in found.collect():
        hits = [(-p, f, o) for f, e, p, o in ranges if r.ip is not None and f <= r.ip <= e]
        best = {o for p, f, o in hits if (p, f) == min(hits)[:2]}
        assert r.owner in best if best else r.owner is None, r
    assert found.count() == len(points)
