"""Addresses of both families against the standard library, and ledgers against a sequential check."""

import hashlib
import ipaddress
import random

from pyspark.sql import functions as F

from leadloom.operators import audit, network


def test_range_keys(spark):
    rng = random.Random(1)
    texts = ["0.0.0.0/0", "::/0", "::1", "10.1.2.3", "10.1.2.3/8", "2a00:1:2:3:4:5:6:7/65", "ffff::/1", "::ffff:1.2.3.4/100", "1.2.3.4/33", "::/129", "x/3", "1.2.3/8", "", "10.0.0.0/", "10.0.0.0/-1", None]
    texts += [f"{ipaddress.IPv6Address(rng.getrandbits(128))}/{rng.randint(0, 128)}" for _ in range(200)] + [f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.randint(0, 32)}" for _ in range(100)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", network.range_key(F.col("t")).alias("k")).collect()
    for r in got:
        try:
            net = ipaddress.ip_network(r["t"], strict=False)
        except ValueError:
            net = None
        if net is None:
            assert r["k"] is None, r
            continue
        value = int(net.network_address)
        assert (r["k"]["family"], r["k"]["bits"]) == (net.version, net.prefixlen), r
        assert (r["k"]["hi"] % 2**64, r["k"]["lo"] % 2**64) == (value >> 64, value % 2**64), r


def test_longest_prefix_of_both_families(spark):
    rng = random.Random(2)
    ranges, asked = [], []
    for i in range(400):
        v6 = i % 2
        base = (0x2A00 << 112 | rng.getrandbits(6) << 90 | rng.getrandbits(3) << 20) if v6 else (10 << 24 | rng.getrandbits(5) << 14 | rng.getrandbits(3) << 4)
        n = rng.randint(16, 128) if v6 else rng.randint(8, 32)
        ranges.append((str(ipaddress.ip_network(((base), n), strict=False)), rng.choice(["AWS", "GCP", "Azure"]), rng.choice(["EC2", "S3", "Azure.X", "GOOGLE"])))
        asked.append(str((ipaddress.IPv6Address if v6 else ipaddress.IPv4Address)(base + rng.randint(0, 3))))
    asked += ["nothing", "8.8.8.8", "::", "", asked[0]]
    generic = lambda p, s: (p, s) in {("AWS", "EC2"), ("GCP", "GOOGLE")} or (p == "Azure" and "." not in s)
    want = {}
    for a in set(asked):
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            want[a] = (None, None, None)
            continue
        fits = [(-n.prefixlen, generic(p, s), p, s) for c, p, s in ranges if (n := ipaddress.ip_network(c)).version == ip.version and ip in n]
        want[a] = (min(fits)[2], min(fits)[3], -min(fits)[0]) if fits else (None, None, None)
    table = spark.createDataFrame([(*r, "eu", "X") for r in ranges] + [("bad", "AWS", "EC2", "eu", "X")], "cidr string, provider string, service string, region string, role string")
    got = network.match_addresses(spark.createDataFrame([(a,) for a in asked], "ip string"), table).collect()
    assert {r["ip"]: (r["provider"], r["service"], r["bits"]) for r in got} == want and sum(v[0] is not None for v in want.values()) > 200
    empty = network.match_addresses(spark.createDataFrame([("::1",)], "ip string"), table.where("false")).collect()
    assert [tuple(r) for r in empty] == [("::1", None, None, None, None, None)]


def sequential(rows):
    """The first broken seq of one run, taken in order."""
    seqs = [r[0] for r in rows]
    before = {r[0]: r for r in rows}
    for seq, payload, prev, own in sorted(rows):
        if seqs.count(seq) > 1:
            return seq, "repeated"
        if seq and seq - 1 not in before:
            return seq, "gap"
        if hashlib.sha256(f"{prev}|{payload}".encode()).hexdigest() != own:
            return seq, "edited"
        if prev != (before[seq - 1][3] if seq else audit.GENESIS):
            return seq, "relinked"
    return None, None


def test_ledger_verification(spark):
    rng, rows, want, entries = random.Random(3), [], {}, []
    for run in range(120):
        own, prev = [], audit.GENESIS
        for seq in range(rng.randint(1, 30)):
            payload = f"p{rng.randint(0, 5)}"
            entries.append((run, seq, payload))
            now = hashlib.sha256(f"{prev}|{payload}".encode()).hexdigest()
            own.append((seq, payload, prev, now))
            prev = now
        n, at = len(own), rng.randrange(len(own))
        how = rng.choice(["", "edit", "drop", "swap", "repeat", "relink", "rewrite"])
        if how == "edit":
            own[at] = (at, "other", *own[at][2:])
        elif how == "drop" and at < n - 1:
            del own[at]
        elif how == "swap" and at:
            own[at], own[at - 1] = (at, *own[at - 1][1:]), (at - 1, *own[at][1:])
        elif how == "repeat":
            own.append(own[at])
        elif how in ("relink", "rewrite"):
            fake = "0" * 63 + "1"
            own[at] = (at, own[at][1], fake, hashlib.sha256(f"{fake}|{own[at][1]}".encode()).hexdigest())
        rows += [(run, *r) for r in own]
        want[run] = sequential(own)
    ledger = spark.createDataFrame(rows, "run_id long, seq long, payload string, prev_hash string, hash string").repartition(5)
    got = {r["run_id"]: (r["bad_seq"], r["problem"]) for r in audit.verify_ledger(ledger).collect()}
    assert got == want and sum(b is None for b, _ in want.values()) > 10
    sound = audit.sealed(spark.createDataFrame(entries, "run_id long, seq long, payload string"))
    assert audit.verify_ledger(sound).where("not ok").count() == 0
    heads = audit.chained(spark.createDataFrame(entries, "run_id long, seq long, payload string"))
    cut = sound.where("not (run_id = 3 and seq = 0 and false)").where("run_id <> 5").join(heads.select("run_id", F.col("entries").alias("n")), "run_id").where("not (run_id = 7 and n > 1 and seq = n - 1)").drop("n")
    missed = {r["run_id"]: r["problem"] for r in audit.verify_ledger(cut, heads).where("not ok").collect()}
    assert missed[5] == "truncated" and set(missed) <= {5, 7} and set(missed.values()) == {"truncated"}
    assert audit.verify_ledger(sound, heads.where("run_id <> 9")).where("not ok").select("problem").collect()[0][0] == "unknown_run"
