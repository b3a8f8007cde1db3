"""Each operator against a brute-force version, a round trip or held-out rows."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from leadloom.llm import jaccard_join, maxscore, packing, resharding, sentencepiece_codec, toxicity, warc

EDGE = [(1, None), (2, ""), (3, " "), (4, "one two"), (5, "one two"), (6, "One TWO  three four"), (7, "a b c d e f g h i j k l m n o p q r s t"), (8, "a b c d e f g h i j k l m n o p q r s x"), (9, "  lead and\ttrail \n"), (10, "a   b\n\n  c"), (11, "é" * 5000), (12, "w " * 4000), (None, "a b c"), (5, "one two"), (13, "<|endoftext|> x")]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, None if i in (2, 7) else "s") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("ids", F.lit(1)).withColumn("n", F.lit("x"))


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_packed(rows, wanted, length):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(wanted)
    for i, ids in wanted.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert bytes(r.ids) == np.asarray(ids[at : at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids)
    for k, parts in sequences.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_covers_every_id_and_fills_every_sequence(spark, sf_dir, texts):
    encode = tokenizer()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs).collect()
    check_packed(rows, {i: encode(t) for i, t in texts.items()}, 2048)


def test_packing_of_odd_texts(spark, edge):
    encode = tokenizer()
    assert encode("foo <|endoftext|> bar") == [21943, 220, 50256, 2318, 1]
    once = edge.where("doc_id is null or doc_id <> 5")
    check_packed(packing.pack(once, length=64, window_sequences=2).collect(), {i: encode(t) for i, t in EDGE if i != 5}, 64)
    assert packing.pack(edge.limit(0)).count() == 0
    assert packing.pack(edge).agg(F.sum("length")).first()[0] == sum(len(encode(t)) for _, t in EDGE)
    many = once.withColumn("source", F.concat(F.lit("q"), F.col("doc_id")))
    targets = {"q6": 5.0, "q7": 1.0, "q12": 0.5, None: 0.25}
    check_packed(packing.pack(many, length=32, window_sequences=1, targets=targets).collect(), {i: encode(t) for i, t in EDGE if i != 5}, 32)


def test_packing_meets_given_targets(spark, sf_dir):
    """Half of the tokens of every window from the smallest source, as long as it lasts; the windows after are full as well."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source in ('src0', 'src1', 'src2')")
    rows = packing.pack(docs, targets={"src1": 0.5, "src0": 0.25, "src2": 0.25}, length=512, window_sequences=4).join(docs.select("doc_id", "source"), "doc_id").collect()
    total, window, held = defaultdict(int), defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in rows:
        total[r.source] += r.length
        at = r.sequence_id * 512 + r.offset
        for p in range(at, at + r.length):
            window[p // 2048][r.source] += 1
    dry = min(total["src1"] // 1024, total["src2"] // 512) - 1
    assert dry > 3
    for w in range(dry):
        assert abs(window[w]["src1"] - 1024) <= 2 and abs(window[w]["src0"] - 512) <= 2 and abs(window[w]["src2"] - 512) <= 2
    assert all(sum(window[w].values()) == 2048 for w in range(max(window)))


def test_windows_keep_target_proportions():
    totals = [100_000, 30_000, 7_000, 50]
    plan = packing.Schedule(totals, packing.shares_of(totals), 4096)
    spent = np.diff(plan.spent(np.arange(34)), axis=0)
    assert (np.abs(spent[:30, :3] - np.asarray(totals[:3]) / sum(totals) * 4096) < 40).all()
    # a queue that runs dry is made up for: every window is full to a token a queue, and all is spent at the end
    assert (np.abs(spent[:33].sum(axis=1) - 4096) <= len(totals)).all()
    assert plan.spent(np.asarray([40]))[0].tolist() == totals
    # deficits are carried: after any number of windows no queue is off by a token from what its share of the clock has earned
    clock = np.interp(np.arange(30), plan.window, plan.clock)
    assert (plan.spent(np.arange(30))[:, 0] == np.floor(clock * plan.shares[0])).all()


def brute_sets(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute_components(docs, k, percent):
    sets = {i: brute_sets(t, k) for i, t in docs}
    ids, index = sorted(sets), defaultdict(set)
    for i in ids:
        for s in sets[i]:
            index[s].add(i)
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in ids:
        for j in {j for s in sets[i] for j in index[s] if j > i}:
            same = len(sets[i] & sets[j])
            if 100 * same >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, sf_dir, texts, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k, percent).collect()}
    assert got == brute_components(texts.items(), k, percent)


def test_near_duplicates_of_families(spark, edge):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(400)}" for _ in range(120)]
    docs = [(100 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(60)]
    chain = [(200 + i, " ".join(f"c{j}" for j in range(i, i + 40))) for i in range(20)]
    rows = [*docs, *chain, *[(i, t) for i, t in EDGE if i is not None and i != 5]]
    frame = spark.createDataFrame([*rows, (None, "a b c")], "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame, k, percent).collect()}
        assert got.pop(None)[1] is None
        assert got == brute_components(rows, k, percent)
    assert jaccard_join.near_duplicates(edge.limit(0)).count() == 0
    assert jaccard_join.near_duplicates(edge).count() == len(EDGE)


def test_a_large_family_of_which_few_link(spark):
    """600 copies with up to 30 own words each: links are few, and the pairs compared stay in proportion to the copies."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(600):
        words = list(base)
        for j in rng.choice(150, int(rng.integers(0, 30)), replace=False):
            words[j] = f"x{i}y{j}" if rng.random() < 0.8 else f"w{rng.integers(150)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame, 3, 90).collect()}
    want = brute_components(rows, 3, 90)
    assert got == want and 100 < len({c for _, c in want.values()}) < 600
    every = jaccard_join.features(frame, jaccard_join.rarity(frame, 3), 3, 90)
    _, shared = jaccard_join.shared_places(every)
    spans = spark.createDataFrame([(i, want[i][1], want[i][1]) for i, _ in rows], "g long, lo long, hi long")
    assert jaccard_join.unconnected(shared, spans.join(shared.select("g").distinct(), "g"), 90).count() < 10 * len(rows)


def test_sentencepiece_equals_the_library_on_the_same_scores(texts):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = public_tokenizers.path("piece_bpe_32k.model")
    proto = pb.ModelProto()
    proto.ParseFromString(open(path, "rb").read())
    proto.trainer_spec.model_type = 1  # best total score over the same pieces
    library, ours = SentencePieceProcessor(model_proto=proto.SerializeToString()), sentencepiece_codec.Model(path)
    score = lambda ids: sum(library.get_score(i) for i in ids)
    words = {w for t in texts.values() for w in t.split()}
    for w in sorted(words):
        best, text = [0.0], "▁" + w
        for end in range(1, len(text) + 1):
            known = [(best[b], text[b:end]) for b in range(max(0, end - ours.longest), end)]
            best.append(max([x + ours.pieces[p][1] for x, p in known if p in ours.pieces] + [best[end - 1] + ours.unknown] * (text[end - 1] not in ours.single)))
        a, b = ours.encode(w), library.encode(w)
        if all(c in ours.single for c in text):
            assert score(a) == pytest.approx(best[-1]) and score(a) >= score(b) - 1e-3, w
    for t in [*texts.values(), "a   b", " x", "ab" * 3000, "日本語", "\n\n", "x\x00y", "é" * 999]:
        assert ours.decode(ours.encode(t)) == t
        assert ours.encode(t) == ours.segment("▁" + t.replace(" ", "▁"))


def test_sentencepiece_commits_within_a_window():
    import public_tokenizers

    model = sentencepiece_codec.Model(public_tokenizers.path("piece_bpe_32k.model"))
    text = "the quick brown fox ".replace(" ", "▁") * 500
    search, out = sentencepiece_codec.StreamingViterbi(model), []
    for c in text:
        out += search.feed(c)
    assert search.widest < 6 * model.longest and len(out) > 1000
    whole = sentencepiece_codec.StreamingViterbi(model)
    assert out + search.finish() == whole.finish(text)
    runs = "ab▁▁▁é▁日本" * 400
    assert model.segment(runs) == sentencepiece_codec.StreamingViterbi(model).finish(runs)


def test_sentencepiece_frames(edge):
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(edge)).collect()
    assert [r.decoded for r in rows] == [r.text for r in rows] and len(rows) == len(EDGE)
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(edge.limit(0))).count() == 0


def test_min_cost_flow_moves_least():
    rng = np.random.default_rng(2)
    for _ in range(20):
        supply = rng.integers(1, 50, 5).tolist()
        capacity = [sum(supply) * (j + 1) // 4 - sum(supply) * j // 4 for j in range(4)]
        cost = [[int(o % 4 != j) for j in range(4)] for o in range(5)]
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == capacity
        home = [sum(s for o, s in enumerate(supply) if o % 4 == j) for j in range(4)]
        moved = sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr))
        assert moved == sum(max(0, h - c) for h, c in zip(home, capacity))


def test_resharding_law(spark, sf_dir, edge, texts):
    rows = resharding.op6_resharding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in rows)
    got, cuts = resharding.reshard(edge, F.pmod(F.hash("source"), F.lit(3)), 4, 3)
    assert got.count() == len(EDGE) and cuts
    assert resharding.reshard(edge.limit(0), F.lit(0), 4, 1)[0].count() == 0


def test_rewrite_moves_only_affected_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assigned, _ = resharding.reshard(docs, F.lit(0), 4, 1)
    written = resharding.rewrite_affected(docs, assigned, str(tmp_path / "out"), 4)
    assert written.count() == assigned.where("shard <> 0").count()


def test_maxscore_equals_brute_force(spark, sf_dir):
    vectors = maxscore.quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    all_rows = [(r.vec_id, np.asarray(r.v)) for r in vectors.collect()]
    got = defaultdict(list)
    for r in maxscore.op7_maxscore(spark, sf_dir).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for i, q in all_rows:
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for j, v in all_rows if j != i)[:10]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]


def test_maxscore_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, [1.0, 5.0]), (3, [nan, 1.0]), (4, None), (5, [None, 1.0]), (6, [1.0, 0.0]), (None, [9.0, 9.0]), (100, [float("inf"), 0.0])]
    v = maxscore.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(v, v.where("vec_id % 100 = 0"), 2).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1 << 20), (0, 2, 2, 1 << 20)]
    assert maxscore.top_k(v.limit(0), v).count() == 0 and maxscore.top_k(v, v.limit(0)).count() == 0
    large = [(0, [1e9, -3.0, 2.0]), (1, [1e9, 1.0, 0.0]), (2, [1e9, 1.0, 1.0]), (3, [1e15, 0.0, 0.0]), (100, [-1e9, 0.5, 0.0])]
    frame = spark.createDataFrame(large, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x")).withColumn("score", F.lit(1))
    v = maxscore.quantized(frame)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in maxscore.top_k(v, v.where("vec_id % 100 = 0"), 3).collect()}
    exact = {i: [int(np.floor(x * 1024)) for x in e] for i, e in large}
    for q in (0, 100):
        best = sorted((-max(min(sum(a * b for a, b in zip(exact[q], exact[i])), 2**63 - 1), -(2**63)), i) for i in exact if i != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(i, -s) for s, i in best]


def test_warc_records(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.record_id: r for r in warc.pages_as_responses(pages).collect()}
    rows = warc.record_bytes(warc.derive(warc.pages_as_responses(pages))).collect()
    assert len(rows) == 2 * len(sources) == len({r.record_id for r in rows})
    digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    linked = {r.record_id: r for r in rows}
    for r in rows:
        s = sources[r.refers_to]
        assert (r.target_uri, r.warc_date, r.payload_digest) == (s.target_uri, s.warc_date, digest(s.payload.encode()))
        assert r.block_digest == digest(r.block.encode()) and r.content_length == len(r.block.encode())
        assert linked[r.linked_to].refers_to == r.refers_to and linked[r.linked_to].warc_type != r.warc_type
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest == r.block.encode() + b"\r\n\r\n" and f"WARC-Refers-To: {r.refers_to}".encode() in head


def test_warc_text(spark):
    html = "<html><head><title>A &amp; B</title><style>x{}</style></head><body><!-- no --><h1>Hi&#33;</h1><p>a &lt;b&gt; c<br>d &#128512;</p><script>bad()</script></body>"
    rows = spark.createDataFrame([("r", None, None, None, html), (None, None, None, None, None)], "record_id string, target_uri string, warc_date string, http_headers string, payload string")
    got = {(r.refers_to, r.warc_type): r.block for r in warc.derive(rows).collect()}
    assert got["r", "conversion"] == "Hi!\na <b> c\nd 😀" and got["", "conversion"] == "" and "title: A & B\r\n" in got["r", "metadata"]


def test_grammar_composes():
    count = toxicity.Matcher(toxicity.Grammar(("vequo",), ("lowei",))).counts
    one = lambda kind: [int(k == kind) for k in toxicity.KINDS]
    assert count("What an idiot.") == one("insult") and count("You are an idiot") == one("targeted_insult")
    assert count("I will kill") == one("threat") and count("he will kill them") == one("targeted_threat")
    assert count("not an idiot") == one("negated") and count("She said idiot") == one("reported")
    assert count("not at all so very much an idiot") == one("insult")
    assert count("Loweischaft da") == one("insult") and count("vequo! vequo") == [2, 0, 0, 0, 0, 0]
    assert count(None) == count("") == count("you said not") == [0] * 6


def test_warc_hostile_pages(spark):
    n = 40_000
    hostile = ["<script>" * n, "<script " * n, "<!--" * n, "<" * n * 4, "<p " * n, "<title>" * n, "<title " * n, "</script   " * n, "".join(f"&#{i};" for i in range(33, n)), "<style>a</style" * n + ">", "&#" * n, " \n" * n]
    rows = spark.createDataFrame([(str(i), "http://a/\r\nX: y", None, "A\rB", h) for i, h in enumerate(hostile)], "record_id string, target_uri string, warc_date string, http_headers string, payload string")
    began = time.time()
    got = {r.refers_to: r for r in warc.derive(rows).where("warc_type = 'conversion'").collect()}
    assert time.time() - began < 30 and len(got) == len(hostile)
    assert got["3"].block == hostile[3] and got["10"].block == hostile[10] and got["0"].block == got["2"].block == got["9"].block == got["11"].block == ""
    assert got["8"].block == "".join(chr(i) for i in range(33, n))
    assert "Target-URI: http://a/%0D%0AX: y\r\n" in got["0"].header


def test_warc_no_rows_and_other_columns(spark):
    rows = spark.createDataFrame([("r", "u", "d", "h", "<p>a</p>b", "x", "y")], "record_id string, target_uri string, warc_date string, http_headers string, payload string, block string, header string")
    assert warc.derive(rows.limit(0)).count() == 0 and [r.block for r in warc.derive(rows).where("warc_type = 'conversion'").collect()] == ["a\nb"]


def test_warc_text_against_a_parser(spark, sf_dir):
    class Seen(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "title", "noscript")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "title", "noscript")

        def handle_data(self, data):
            if self.hidden <= 0:
                self.parts.append(data)

    def words_of(html):
        parser = Seen()
        parser.feed(html)
        parser.close()
        return "".join("".join(parser.parts).split())

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.record_id: r.payload for r in warc.pages_as_responses(pages).collect()}
    rows = warc.derive(warc.pages_as_responses(pages)).where("warc_type = 'conversion'").collect()
    # names beyond warc.NAMED stay as they are
    same = sum("".join(unescape(r.block).split()) == words_of(sources[r.refers_to]) for r in rows)
    assert same >= 0.99 * len(rows), (same, len(rows))


def test_toxicity_scores_by_brute_force(spark):
    """Words learned, clauses counted and scores given again in plain Python, without any bound on terms, lengths or clauses."""
    long = "q" * 45
    toxic = [f"Vorak {w} und {w}{i} da. {long} {w}x! ok" + " idiot!" * (i % 9) for i, w in enumerate(f"w{a}{b}" for a in "abcdefgh" for b in "ijklm")]
    clean = [f"das {w}{i} ist gut. und {i} mehr" for i, w in enumerate(f"v{a}{b}" for a in "abcdefgh" for b in "ijklm")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(toxic + clean)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < len(toxic)).cast("int").alias("toxic"))
    learned = toxicity.learn_words(docs, labels)
    training = [(t, int(i < len(toxic))) for i, t in enumerate(toxic + clean) if zlib.crc32(str(i).encode()) % 5]
    in_docs, hits, contexts = Counter(), Counter(), defaultdict(set)
    for text, label in training:
        found = [w for w in regex.split(r"[^\p{L}]+", text.lower())]
        for w in {w for w in found if w}:
            in_docs[w] += 1
            hits[w] += label
        for before, w in zip(["", *found], found):
            contexts[w].add(before)
    sure = {w for w in in_docs if hits[w] >= 8 and hits[w] >= 0.9 * in_docs[w]}
    assert set(learned[0]) <= sure and {w for w in sure if len(contexts[w]) >= 25} <= set(learned[0]) | {w for w in sure if any(w.startswith(s) for s in learned[1])}
    rows = toxicity.score_documents(docs, docs, labels).collect()
    counts = toxicity.Matcher(toxicity.Grammar(tuple(learned[0]), tuple(learned[1]))).counts
    by_clauses = defaultdict(set)
    for r in rows:
        by_clauses[tuple(counts((toxic + clean)[r.doc_id]))].add(round(r.score, 12))
    assert all(len(v) == 1 for v in by_clauses.values()) and max(max(c) for c in by_clauses) > 3


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 500 and all(0 <= r.score <= 1 for r in rows)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(1 - r.toxic for r in rows)
    assert right > 0.97 and caught > 0.8 and wrong < 0.01, (right, caught, wrong)


def test_toxicity_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_documents(edge, edge.select("doc_id", "text"), none).collect()
    assert len(rows) == len(EDGE) and {r.predicted for r in rows} == {0}
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 1), (4, 1)], "doc_id long, toxic int")
    assert toxicity.score_documents(edge, edge.select("doc_id", "text"), labels).count() == len(EDGE)


def test_rewritten_shards_hold_every_row_once(spark, edge, tmp_path):
    docs = edge.unionByName(edge).unionByName(edge.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    for n_old, n_new, old in ((3, 4, F.pmod(F.hash("source", "doc_id"), F.lit(3))), (4, 4, F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1)), (1, 1, F.lit(0))):
        assigned, cuts = resharding.reshard(docs, old, n_new, n_old)
        table = resharding.rewrite_shards(assigned, cuts, str(tmp_path / f"{n_old}-{n_new}"), n_new)
        key = lambda r: repr([r[c] for c in docs.columns])
        rows = table.collect()
        assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))
        assert sorted((r.shard, r.slot) for r in rows) == sorted((r.shard, r.slot) for r in assigned.collect())
        assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assigned, cuts = resharding.reshard(docs, F.lit(0), 4, 1)
    moved = resharding.rewrite_affected(docs, assigned, str(tmp_path / "moved"), 4)
    assert moved.count() == assigned.where("shard <> 0").count()
