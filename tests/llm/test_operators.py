import io
import itertools
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard_join, langid, lm_scoring, mixing, quality, queries, sharding, token_output, toxicity, url_filters, wavelet
from millrace.llm.arrow import utf8
from millrace.llm.graph import components
from millrace.llm.shingles import shingle_sets, word_hashes
from tests.compare import duck, rows
from tests.llm.conftest import CASES, SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), duck(SF).execute(queries.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


# 1 sharding


def test_sharding(spark, cases, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard(docs, 24).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert len(got) == len(texts)
    sizes, places = Counter(), defaultdict(list)
    for r in got:
        assert r["size"] == len(texts[r["id"]]) + 8 and r["crc"] == zlib.crc32(texts[r["id"]])
        sizes[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert sorted(places) == list(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(r["size"] for r in got)
    assert sharding.shard(cases, 3).count() == len(CASES) and sharding.shard(nothing, 3).count() == 0
    assert sharding.assigned(cases, 3).count() == len(CASES)


def test_rebalancing_moves_few_slots(spark, tmp_path):
    totals = spark.createDataFrame([(i, 100 + i % 7, 1) for i in range(200)], "virtual_slot int, bytes long, records long")
    first = sharding.build_map(totals, 4)
    sharding.save_map(first, str(tmp_path / "map"))
    second = sharding.rebalance(sharding.load_map(spark, str(tmp_path / "map")), totals, 5)
    sharding.save_map(second, str(tmp_path / "map"))
    was, now = ({r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), v).collect()} for v in (1, 2))
    moved = [s for s in was if was[s] != now[s]]
    assert len(now) == 200 and len(moved) <= 200 / 5 + 5 and {now[s] for s in moved} == {4}
    loads = Counter()
    for r in totals.collect():
        loads[now[r["virtual_slot"]]] += r["bytes"]
    assert max(loads.values()) - min(loads.values()) <= 2 * 106
    third = {r["virtual_slot"]: r["shard"] for r in sharding.rebalance(sharding.load_map(spark, str(tmp_path / "map")), totals, 3).collect()}
    assert set(third.values()) == {0, 1, 2}


# 2 LM scoring


def ids_of(texts, own=lm_scoring._NO_WORDS):
    h, counts = word_hashes(*utf8(pa.array(texts, pa.string())))
    return lm_scoring._ids(h, own), counts


def test_scores_equal_brute_force(spark, cases, nothing):
    flat = lm_scoring.train(cases, lm_scoring.vocabulary(cases, own=0), rounds=1)
    net = lm_scoring.Network(flat)
    got = {(r["id"], r["n_words"]): r for r in lm_scoring.score(cases, flat).collect()}
    for doc_id, text, _, _ in CASES[:8]:
        n = len(WORDS.findall(text or ""))
        ids, _ = ids_of([text])
        total = 0.0
        for i in range(n):
            around = [ids[j] if 0 <= j < n else lm_scoring._IDS for j in (i - 2, i - 1, i + 1, i + 2)]
            hidden = np.tanh(sum(net.vectors[a] * p for a, p in zip(around, net.places, strict=True)) + net.hidden_bias)
            c, m = divmod(int(ids[i]), lm_scoring.MEMBERS)
            soft = lambda z: z - np.log(np.exp(z).sum())
            total += soft(hidden @ net.class_weights + net.class_bias)[c] + soft((hidden + net.class_vectors[c]) @ net.member_weights + net.member_bias)[m]
        assert got[doc_id, n]["log_prob"] == pytest.approx(total, rel=1e-4, abs=1e-6)
    assert got[3, 0]["mean_log_prob"] is None
    none = lm_scoring.vocabulary(nothing)
    assert lm_scoring.score(nothing, lm_scoring.train(nothing, none)).count() == 0
    assert lm_scoring.score(nothing, lm_scoring.train(nothing, none), words=none).count() == 0


def test_gradient_and_probabilities():
    padded, at = lm_scoring.padded_ids(*ids_of(["a b c d e f g", "", "h a c"]))
    net = lm_scoring.Network()
    net.flat *= 3
    g, rng = net.gradient(padded, at), np.random.default_rng(1)
    small = len(net.vectors) * lm_scoring.DIM
    for k in [*rng.integers(0, len(net.flat), 4), *rng.integers(small, len(net.flat), 8), *(int(padded[j]) * lm_scoring.DIM + 3 for j in (*at[:4], 0))]:
        up, down = net.flat.copy(), net.flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        slope = (lm_scoring.Network(down).forward(padded, at).mean() - lm_scoring.Network(up).forward(padded, at).mean()) / 2e-2
        assert slope == pytest.approx(g[k], abs=3e-4)
    # All ids in one place: probabilities add up to 1.
    every = np.arange(lm_scoring._IDS)
    around = np.concatenate([np.array([*padded[:4][:2], i, *padded[4:6]]) for i in every])
    assert np.exp(net.forward(around, 5 * every + 2)).sum() == pytest.approx(1, abs=1e-3)
    stretches = [(p[a], [p[a + k] for k in (-2, -1, 1, 2)]) for p, a in lm_scoring._stretches(padded, at, 3)]
    assert np.array_equal(np.concatenate([s[0] for s in stretches]), padded[at])
    assert np.array_equal(np.concatenate([np.stack(s[1], 1) for s in stretches]), np.stack([padded[at + k] for k in (-2, -1, 1, 2)], 1))


def shuffled(docs):
    pairs = F.transform(F.split("text", r"\s+"), lambda w, i: F.struct(F.xxhash64(w, i).alias("h"), w.alias("w")))
    return docs.withColumn("text", F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))


def test_context_is_worth_more_than_frequencies(spark):
    """Learned on two thirds, asked about the rest: above the frequencies of the ids by a margin, and order above disorder."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen, held = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    words = lm_scoring.vocabulary(seen)
    flat = lm_scoring.train(seen, words)
    per_word = lambda d, net: lm_scoring.score(d, net, words=words).agg(F.sum("log_prob") / F.sum("n_words")).first()[0]
    start = lm_scoring.Network(counts=words.per_id())
    start.vectors[:] = 0
    n = words.per_id() + 1
    alone, at = lm_scoring.padded_ids(np.arange(lm_scoring._IDS), np.ones(lm_scoring._IDS, int))
    assert np.abs(start.forward(alone, at) - np.log(n / n.sum())).mean() < 0.2
    assert per_word(held, flat) > per_word(held, start.flat) + 0.1
    real, mixed = ({r["id"]: r["log_prob"] for r in lm_scoring.score(d, flat, words=words).where("n_words >= 20").collect()} for d in (held, shuffled(held)))
    assert np.mean([real[i] > mixed[i] for i in real]) > 0.7


def test_network_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = lm_scoring.vocabulary(docs)
    one, four = (lm_scoring.train(docs.repartition(n), words) for n in (1, 4))
    assert np.array_equal(one, four)


@pytest.mark.parametrize("frequent", [0, 300, lm_scoring.FREQUENT])
def test_words_are_scored_not_ids(spark, cases, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(cases.select("doc_id", "text"))
    words = lm_scoring.vocabulary(docs, frequent=frequent, own=200)
    flat = lm_scoring.train(docs, words)
    net, own, known = lm_scoring.Network(flat), words.own.tolist(), {}
    split = lambda t: [known.setdefault(w, int(word_hashes(*utf8(pa.array([w])))[0][0])) for w in WORDS.findall(lowered(t))]
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n = Counter(h for _, t in texts for h in split(t))
    assert len(own) == min(200, len(words.frequent)) and len(words.frequent) <= frequent
    assert dict(zip(words.frequent.tolist(), words.n.tolist(), strict=True)) | {r["word"] % 2**64: r["n"] for r in words.rest.collect()} == n
    place = lambda h: own.index(h) if h in own else len(own) + (h >> 33) % (lm_scoring._IDS - len(own))
    totals, expected = Counter(), []
    for h, k in n.items():
        totals[place(h)] += k
    probe = [*texts[:12], *((i, t) for i, t in texts[-len(CASES) :] if len(t or "") < 1000), (-1, "the cat zqxj"), (-2, "the cat mat")]
    for doc_id, text in probe:
        ids, counts = ids_of([text], words.own)
        assert ids.tolist() == [place(h) for h in split(text)]
        total = net.forward(*lm_scoring.padded_ids(ids, counts)).sum() if len(ids) else 0
        for h in split(text):
            if h not in own:
                total += np.log(n[h] or (lm_scoring._IDS - len(own)) / 2**64) - np.log(totals[place(h)] + 1)
        expected.append((str(doc_id), int(counts[0]), float(total)))
    got = [(str(r["id"]), r["n_words"], r["log_prob"]) for r in lm_scoring.score(spark.createDataFrame(probe, "doc_id long, text string"), flat, words=words).collect()]
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(expected)]
    assert [x[2] for x in sorted(got)] == pytest.approx([x[2] for x in sorted(expected)], rel=1e-4, abs=1e-4)
    unseen, seen = (next(x[2] for x in got if x[0] == k) for k in ("-1", "-2"))
    assert unseen < seen - 20


def test_units_mask_every_word_once_a_round(spark, cases, monkeypatch):
    docs, seen = cases.select("doc_id", "text").where("doc_id IS NOT NULL"), Counter()

    def gradient(net, padded, at):
        seen.update(zip(padded[at].tolist(), zip(*(padded[at + k].tolist() for k in (-2, -1, 1, 2)), strict=True), strict=True))
        return np.zeros_like(net.flat)

    monkeypatch.setattr(lm_scoring.Network, "gradient", gradient)
    flat = lm_scoring.Network().flat
    for r in lm_scoring.dealt(docs, np.empty(0, np.uint64), 3 * lm_scoring.UNIT).collect():
        counts, ids = np.frombuffer(r["counts"], "<i4").astype(np.int64), np.frombuffer(r["ids"], "<u2")
        lm_scoring.learn_unit(flat, np.ones_like(flat), ids, counts)
    padded, at = lm_scoring.padded_ids(*ids_of([t for i, t, _, _ in CASES if i is not None]))
    assert seen == Counter(zip(padded[at].tolist(), zip(*(padded[at + k].tolist() for k in (-2, -1, 1, 2)), strict=True), strict=True))


# 3 decontamination


def brute_hits(text, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    words, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        n = min(window, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), found


def test_decontamination_of_short_and_shared_items(spark, cases, nothing):
    items = [(1, "The cat sat on the mat and the dog lay by the fire all night"), (2, "DORT"), (3, None), (4, "..."), (5, "le chat est"), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(cases, bench).collect()
    assert len(got) == len(CASES)
    expected = Counter((i, *brute_hits(t, items)[:2], tuple(sorted(map(str, brute_hits(t, items)[2])))) for i, t, _, _ in CASES)
    assert Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == expected
    kept = decontamination.decontaminate(cases, bench)
    assert kept.columns == cases.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7, 8]
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(cases, bench, remove="spans").where("doc_id IS NOT NULL").collect()}
    assert cut[1] == "long" and cut[6] == "" and cut[8] == "12345 67890 !!!" and cut[3] is None
    assert decontamination.report(nothing, bench).count() == 0
    assert {r["n_hit"] for r in decontamination.report(cases, bench.limit(0)).collect()} == {0}


def test_short_items_are_found_beside_long_ones(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    common = Counter(w for _, t in texts for w in re.findall(r"[a-z]+", lowered(t)))
    word = common.most_common(1)[0][0]
    extra = [("x1", "zqxjv"), ("x2", word), ("x3", f"{word} {word}"), ("x4", " ".join(texts[3][1].split()[:4])), ("x7", " ".join(texts[5][1].split()[2:9])), ("x12", " ".join(texts[7][1].split()[:12]))]
    both = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").unionByName(spark.createDataFrame(extra, "item_id string, text string"))
    items = [(r["item_id"], r["text"]) for r in both.collect()]
    got = {r["id"]: (r["n_words"], r["n_hit"], set(r["items"])) for r in decontamination.report(docs, both).collect()}
    assert got == {i: brute_hits(t, items) for i, t in texts}


def test_passes_over_a_large_benchmark_agree(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(str, decontamination.report(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BYTES_PER_PASS", 1 << 18)
    assert sorted(map(str, decontamination.report(docs, bench).collect())) == one


# 4 toxicity


def test_toxicity_held_out(spark, cases, nothing):
    got = toxicity.op4_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    seen = labels.merge(got, on="doc_id")
    test = seen[seen.held_out]
    assert (test.predicted == test.toxic).mean() > 0.9 and got.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    empty = toxicity.train(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert toxicity.score(cases, empty).count() == len(CASES) and toxicity.score(nothing, empty).count() == 0


def brute_places(text):
    """Places of the distinct n-grams, in plain integers."""
    raw = re.sub(rb"[ \t\n\v\f\r]+", b" ", b" " + lowered(text).encode() + b" ") if text else b""
    out = set()
    for order in toxicity.ORDERS:
        for i in range(len(raw) - order + 1):
            h = order
            for byte in raw[i : i + order]:
                h = (h * 257 + byte) % 2**64
            out.add(h * 0x9E3779B97F4A7C15 % 2**64 >> (64 - toxicity.BITS))
    return out


def test_scores_are_the_logistic_of_weighed_ngrams(spark, cases):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labelled = docs.join(labels, "doc_id").collect()
    weights, bias = toxicity.train(spark.createDataFrame(labelled))
    odd = cases.where("doc_id IS NOT NULL").select((F.col("doc_id") + 10**6).alias("doc_id"), "text")
    got = {r["id"]: r["score"] for r in toxicity.score(docs.unionByName(odd), (weights, bias)).collect()}
    for r in [*docs.limit(25).collect(), *odd.collect()]:
        z = sum(float(weights[k]) for k in brute_places(r["text"])) + bias
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    # Log-count ratios of the sample, by counting: places that say little, or are met in few texts, have no weight.
    seen = [(brute_places(r["text"]), r["toxic"]) for r in labelled]
    ones = sum(t for _, t in seen)
    with_, without = (Counter(k for places, t in seen if t == label for k in places) for label in (1, 0))
    for k in list(with_.keys() | without.keys())[:20000]:
        ratio = np.log((with_[k] + 0.5) / (ones + 1) / ((without[k] + 0.5) / (len(seen) - ones + 1)))
        used = with_[k] + without[k] >= toxicity.MIN_TEXTS and abs(ratio) >= toxicity.MIN_RATIO
        assert used or weights[k] == 0


def test_place_counts_once():
    raw = np.frombuffer(b"You  IDIOT you idiot", np.uint8)
    assert set(toxicity.ngrams(raw)) == set(toxicity.ngrams(np.frombuffer(b"you idiot you idiot", np.uint8)))
    assert len(toxicity.ngrams(np.empty(0, np.uint8))) == 0


# 5 token output


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 'sé,.!3\n\t 　\xa0\x1c漢A<|endoftext|>"), max_size=40), max_size=4))
def test_cached_words_encode_as_the_tokenizer_does(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = token_output._ENCODERS.setdefault("plain", Tokenizer.from_file(path))
    ids, sizes = token_output.encoder(path).encode(pa.array(texts, pa.string()))
    expected = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert sizes.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_known_words_take_little_memory(tokenizer):
    encode = token_output.Encoder(tokenizer)
    words = ["".join(x) for x in itertools.islice(itertools.product("etaoinshrdlu", repeat=5), 100_000)]
    encode.encode(pa.array(["a text before"]))
    tracemalloc.start()
    encode.encode(pa.array([" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]))
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken < 64 * len(words)


def test_long_words_are_forgotten(tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "KEPT_IDS", 1 << 14, raising=False)
    encode, plain = token_output.Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    for i in range(40):
        text = f"one {chr(97 + i % 26) * 3}" + "word" * 2000 + f"{i}x two, one  {i}"
        ids, _ = encode.encode(pa.array([text]))
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert encode.used < 1 << 15


def test_uris_of_hadoop_are_understood():
    assert token_output.portable("s3a://bucket/k") == "s3://bucket/k" and token_output.portable("file:///tmp/x") == "file:///tmp/x"


def test_files_of_lost_attempts_are_deleted(spark, cases, tokenizer, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "shard-000000-0000-99999.wm").write_bytes(b"half")
    shards = token_output.write(cases, f"file://{tmp_path}/t", tokenizer)
    assert {p.name for p in (tmp_path / "t").iterdir()} == {r["path"].rpartition("/")[2] for r in shards.collect()}


def test_round_trip(spark, cases, nothing, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    shards = token_output.write(cases, f"file://{tmp_path}/t", tokenizer)
    got = sorted(map(tuple, token_output.read(shards).collect()), key=lambda r: r[1])
    start, expected = 0, []
    order = sorted(CASES, key=lambda c: (c[0] is not None, c[0] or 0))
    for doc_id, text, _, _ in order:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    assert token_output.read(token_output.write(nothing, f"file://{tmp_path}/e", tokenizer)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 7), min_size=1, max_size=60), st.integers(1, 3))
def test_wavelet_matrix(values, spread):
    tokens = np.array(values, np.uint16) * spread
    r = wavelet.Reader(io.BytesIO(wavelet.dumps(tokens, np.array([7]), np.array([len(tokens)]))))
    assert r.tokens().tolist() == tokens.tolist() == [r.access(i) for i in range(len(tokens))] == r.document(0).tolist()
    for t in {*tokens.tolist(), 6, 70_000}:
        at = np.flatnonzero(tokens == t)
        assert r.count(t) == len(at) and r.count(t, 1, len(tokens)) == (at >= 1).sum()
        assert [r.select(t, k) for k in range(len(at))] == at.tolist()
        with pytest.raises(IndexError):
            r.select(t, len(at))


# 6 quality


def test_quality_measures(spark, cases, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(cases.select("doc_id", "text"))
    texts = docs.collect()
    got = {(r["id"], r["word_chars"], r["n_words"]): r for r in quality.score(docs).collect()}
    for doc_id, text in texts:
        words = WORDS.findall(text or "")
        tri = Counter(zip(words, words[1:], words[2:], strict=False))
        rep = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        r = got[doc_id, sum(map(len, words)), len(words)]
        assert r["n_repeat_words"] == len(rep) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(rep) > 50 * len(words)) and not (r["kept"] and r["base_failed"])
    assert quality.score(nothing).count() == 0


def test_lines_are_judged_first():
    good = " ".join(f"A{i} b{i} c{i} d{i} e{i} f{i}." for i in range(12))
    nav = "Home | News | Sport | Weather | Contact"
    both = quality.judge(f"{good}\n{nav}\nAll rights reserved.\nRead more")
    assert both["kept"] and both["cleaned"] == good and both["n_failed_lines"] == 3
    assert not quality.judge("\n".join(f"{nav} {i}" for i in range(30)))["kept"]
    assert quality.judge(good.removesuffix("."))["kept"]
    words = lambda line: quality.words_of(line)
    for line in ("Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Read more."):
        assert quality.line_fails(line, words(line)) == "boilerplate"
    assert quality.line_fails("Das Recht der Straße bleibt allen vorbehalten.", words("Das Recht der Straße bleibt allen vorbehalten.")) == ""


# 7 URL filters


def test_ids_of_any_size_and_long_urls(spark):
    pages = spark.createDataFrame([(2**62, "https://a.b.example.org/" + "x" * 70_000), (-(2**62), None), (None, "http://" + ".".join(["a"] * 120) + "/")], "page_id long, url string")
    got = url_filters.evaluate(url_filters.with_fetch_times(pages), url_filters.entries_of(pages))
    assert got.count() == 3 and got.where("id > 0 AND fetched_at IS NULL").count() == 0


def test_entries_hold_when_they_were_active(spark):
    d = lambda s: __import__("datetime").date.fromisoformat(s)
    t = lambda s: __import__("datetime").datetime.fromisoformat(s)
    entries = spark.createDataFrame([("bad.com", "spam", "add", d("2024-01-10")), ("bad.com", "spam", "remove", d("2024-02-10")), ("x.bad.com", "adult", "add", d("2024-01-20")), (None, "spam", "add", d("2024-01-01")), ("Same.org", "a", "add", d("2024-01-05")), ("same.org", "a", "remove", d("2024-01-05"))], "domain string, category string, action string, day date")
    rows_ = [(1, "http://u:p@X.Bad.com.:80/a", t("2024-01-15")), (2, "https://x.bad.com", t("2024-03-01")), (3, "https://bad.com/", t("2024-02-10")), (4, "https://bad.com/", t("2024-02-09T23:59:59")), (4, "https://bad.com/", t("2024-02-09T23:59:59")), (5, None, t("2024-01-15")), (6, "no url", None), (7, "https://notbad.com", t("2024-01-15")), (8, "http://same.org/x", t("2024-06-01"))]
    captures = spark.createDataFrame(rows_, "page_id int, url string, fetched_at timestamp_ntz")
    got = sorted((r["id"], r["blocked"], r["entry_domain"]) for r in url_filters.evaluate(captures, entries).collect())
    assert got == [(1, True, "bad.com"), (2, True, "x.bad.com"), (3, False, None), (4, True, "bad.com"), (4, True, "bad.com"), (5, False, None), (6, False, None), (7, False, None), (8, False, None)]
    assert url_filters.evaluate(captures.limit(0), entries).count() == 0
    assert url_filters.evaluate(captures, entries.limit(0)).where("blocked").count() == 0


# 8 Jaccard join


def brute_components(docs, words, percent):
    sets = []
    for doc_id, text in docs:
        w = WORDS.findall(lowered(text))
        sets.append((doc_id, frozenset(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        both = len(a & b)
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            parent[root(j)] = root(i)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return Counter((doc_id, len(s), least.get(root(i)) if s else doc_id) for i, (doc_id, s) in enumerate(sets))


@pytest.mark.parametrize(("words", "percent", "part"), [(4, 85, 1 << 14), (5, 80, 1 << 14), (3, 60, 1 << 14), (4, 85, 20), (3, 60, 20)])
def test_join_equals_brute_force(spark, cases, monkeypatch, words, percent, part):
    """Also with pages split in parts of 20, by sizes of all nodes."""
    monkeypatch.setattr(jaccard_join, "PAGE_PART", part)
    if part == 20:
        monkeypatch.setattr(jaccard_join, "SAMPLED", 1)
    rng = np.random.default_rng(5)
    base, made = [f"w{i}" for i in range(60)], []
    for i in range(150):  # near copies around the threshold
        w = list(base[: int(rng.integers(8, 60))] if i % 3 == 0 else base)
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, len(w)))] = f"v{int(rng.integers(0, 9))}"
        made.append((100 + i, " ".join(w)))
    docs = cases.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = Counter((r["id"], r["n_shingles"], r["component"]) for r in jaccard_join.join(docs, words=words, percent=percent).collect())
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], words, percent)


def test_join_of_whole_table_and_of_nothing(spark, cases, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.op8_jaccard_join(spark, SF).collect())
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 85)
    assert jaccard_join.join(nothing).count() == 0
    kept = jaccard_join.deduplicate(cases, words=4, percent=85)
    assert kept.columns == cases.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, None, 6, 7, 8])


def test_one_row_of_each_group_stays(spark):
    rows_ = [(5, "A b c d e f"), (5, "B q r s t u"), (3, "B q r s t u"), (None, "A b c d e f"), (None, "z z z z z y"), (None, "z z z z z y"), (None, None), (None, None), (8, ""), (8, " ")]
    docs = spark.createDataFrame([(i, t, {"k": 1}) for i, t in rows_], "doc_id long, text string, `__unit.x` map<string,int>")
    kept = jaccard_join.deduplicate(docs, words=4, percent=85)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, "A b c d e f"), (3, "B q r s t u"), (None, "z z z z z y"), (None, None), (8, ""), (8, " ")])


def test_large_groups_of_copies_and_rows_without_id(spark):
    rng = np.random.default_rng(11)
    base, made = [f"w{i}" for i in range(80)], []
    for i in range(5000):  # one group: each copy has the base with up to three words changed
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 80))] = f"v{int(rng.integers(0, 500))}"
        made.append((i, " ".join(w)))
    made += [(None, "one text without an id that is there very often")] * 1000
    got = jaccard_join.join(spark.createDataFrame(made, "doc_id long, text string").repartition(8), words=4, percent=85).collect()
    sets = [frozenset(zip(*(t.split()[k:] for k in range(4)), strict=False)) for _, t in made[:5000]]
    groups = {r["id"]: r["component"] for r in got if r["id"] is not None}
    # All overlaps at once: shingles that most sets have by a product of matrices, others by who has them.
    have = defaultdict(list)
    for i, one in enumerate(sets):
        for shingle in one:
            have[shingle].append(i)
    often = [x for x in have if len(have[x]) > 100]
    matrix = np.zeros((5000, len(often)), np.float32)
    for k, x in enumerate(often):
        matrix[have[x], k] = 1
    both = matrix @ matrix.T
    for x in have.keys() - set(often):
        both[np.ix_(have[x], have[x])] += 1
    size = np.array([len(x) for x in sets])
    links = 100 * both >= 85 * (size[:, None] + size - both)
    least = np.arange(5000)
    while True:
        now = np.array([least[row].min() for row in links])
        if np.array_equal(now, least):
            break
        least = now
    assert [groups[i] for i in range(5000)] == least.tolist() and len(set(least)) > 10
    assert sum(r["id"] is None and r["component"] is None for r in got) == 1000


def test_forest_loses_no_point():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, int(rng.integers(1, 200))).astype(np.uint64)) for _ in range(150)]
    points, sizes = np.stack([jaccard_join.point(s) for s in sets]).astype(np.uint8), np.array([len(s) for s in sets])
    group = np.sort(rng.integers(0, 5, 150))
    forest = jaccard_join.Forest(points, sizes, group, 6)
    fine = np.stack([jaccard_join.point(s, jaccard_join.FINE) for s in sets])
    assert np.array_equal(jaccard_join._folded(fine), points)
    for percent in (20, 50, 85):
        found = {(int(q), int(x)) for part in forest.search(points, sizes, group, percent) for q, x in zip(*part, strict=True)}
        assert all(group[q] == group[x] for q, x in found) and len(found) < 150 * 150 / 2
        for q in range(150):
            for i in range(150):
                both = len(np.intersect1d(sets[q], sets[i]))
                if group[q] == group[i] and 100 * both >= percent * (sizes[q] + sizes[i] - both):
                    assert (q, i) in found
                    assert jaccard_join._reaches(fine[[q]], fine[[i]], sizes[[q]], sizes[[i]], percent)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 2), st.integers(0, 5)), max_size=40), st.integers(1, 7), st.sets(st.integers(0, 4)))
def test_pages_of_one_set_are_dropped(rows_, step, split):
    rows_ = sorted(rows_)
    batches = [pa.RecordBatch.from_pydict({"page": pa.array([r[0] for r in part], pa.int64()), "part": pa.array([r[1] for r in part], pa.int32()), "node": pa.array([r[2] for r in part], pa.int64()), "pivot": pa.array([False] * len(part), pa.bool_())}) for part in (rows_[i : i + step] for i in range(0, len(rows_), step))]
    got = [tuple(r.values())[:3] for b in jaccard_join._entered(sorted(split))(iter(batches)) for r in b.to_pylist()]
    on = Counter((p, q) for p, q, _ in set(rows_))
    assert got == [r for r in sorted(set(rows_)) if on[r[:2]] > 1 or r[0] in split]


def test_components(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, 200), (200, 300), (7, 7), (5, 40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}


def test_shingles_do_not_depend_on_neighbours():
    texts = ["A b c d e", "", "a  B\tc\nd E", "x", "x y", None, "ünï çode wörds hére"]
    alone = [shingle_sets(*utf8(pa.array([t], pa.string())), 4)[0].tolist() for t in texts]
    assert [s.tolist() for s in shingle_sets(*utf8(pa.array(texts)), 4)] == alone
    assert alone[0] == alone[2] and len(alone[0]) == 2 and alone[1] == [] and alone[3] != alone[4]


# 9 language ID


def test_language_held_out(spark, cases, nothing):
    got = langid.op9_langid(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    test = docs.merge(got[got.held_out], on="doc_id")
    assert (test.lang == test.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    prototypes = langid.learn(cases)
    by = {(r["id"], r["lang_pred"]): r["score"] for r in langid.identify(cases, prototypes).collect()}
    assert {k for k in by if k[1] == "und"} == {(i, "und") for i in (3, 4, 5, 8)} and all(by[k] == 0 for k in by if k[1] == "und")
    assert (None, "fr") in by and (7, "de") in by
    kept = langid.accepted(cases, prototypes)
    assert kept.columns == cases.columns and kept.count() == 6
    assert {r["lang_pred"] for r in langid.identify(cases, {}).collect()} == {"und"}
    assert langid.identify(nothing, langid.learn(nothing)).count() == 0


def test_text_vector_is_the_bundle_of_bound_letters():
    space = langid.Space(64)
    keys, counts = np.unique(langid.trigrams("Ab, ab"), return_counts=True)
    assert len(keys) == 3 and counts.sum() == 5
    expected = np.zeros(64)
    for a, b, c in [" ab", "ab ", "b a", " ab", "ab "]:
        expected += np.roll(space.letter(ord(a)), 2) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c))
    assert np.array_equal(space.bundle(keys, counts), expected)


# 10 mixing


def test_water_filling_equals_rounds_of_clamping(spark):
    rng = np.random.default_rng(2)
    for _ in range(4):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 1000, 9))}
        weights = {s: float(rng.integers(1, 9)) for s in sizes}
        total, clamped = 1.5 * sum(sizes.values()), set()
        while True:
            left, w = total - sum(2 * sizes[s] for s in clamped), sum(weights[s] for s in weights if s not in clamped)
            target = {s: 2.0 * sizes[s] if s in clamped else left * weights[s] / w for s in sizes}
            over = {s for s in sizes if s not in clamped and target[s] > 2 * sizes[s]}
            if not over:
                break
            clamped |= over
        df = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "src string, source_size long, weight double")
        got = {r["src"]: r["target"] for r in mixing.water_fill(df).collect()}
        assert got == pytest.approx(target)


def test_repetitions_stay_with_their_source(spark):
    """Rows equal in id and text, of different sources, and copies on a border."""
    rows_ = [(1, "one two three", "a", 1), (1, "one two three", "b", 2), (1, "one two three", "b", 3), (2, "four five", "a", 4), (3, None, "a", 5), (4, " ".join(["w"] * 4000), None, 6), (None, "six", None, 7), (None, "six", None, 8)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string, `row.no` int")
    told = {}
    for parts in (1, 3, 8):
        got = Counter()
        for r in mixing.repeated(docs.repartition(parts)).collect():
            got[r["source"]] += len(WORDS.findall(r["text"] or ""))
            assert any(r["row.no"] == n and (text or "").startswith(r["text"] or "") for _, text, _, n in rows_)
        told[parts] = got
    assert told[1] == told[3] == told[8]
    drawn = mixing.mix(docs).toPandas()
    by = (drawn["size"] * drawn.repeats + drawn.extra).groupby(drawn.src.fillna("none")).sum()
    assert {k or "none": n for k, n in told[1].items()} == {k: n for k, n in by.items() if n}


def test_columns_that_share_a_name_with_the_map_are_kept(spark, cases):
    docs = cases.withColumn("shard", F.lit(7)).withColumn("a.b", F.lit(8)).withColumn("input_map_version", F.lit(9)).withColumn("map_version", F.lit(10))
    got = sharding.assigned(docs, 3)
    assert set(got.columns) == {*cases.columns, "input_shard", "a.b", "input_map_version", "input_map_version_", "virtual_slot", "shard", "map_version"}
    assert got.where("input_shard = 7 AND `a.b` = 8 AND map_version = 1").count() == len(CASES)


def test_copies_without_id_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, None)] * 300 + [(5, "x")] * 200 + [(6, "y")], "doc_id long, text string")
    places = defaultdict(list)
    for r in sharding.shard(docs, 3).collect():
        places[r["shard"]].append(r["slot"])
    assert sum(map(len, places.values())) == 501 and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_mixture_meets_its_targets(spark, cases, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.op10_mixing(spark, SF).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    assert (got.taken <= 2 * got["size"]).all()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), said=("source_size", "first"))
    assert (per["size"] == per.said).all() and ((per.taken - per.target).abs() <= 0.5).all()
    assert rows(mixing.op10_mixing(spark, SF).toPandas()) == rows(mixing.op10_mixing(spark, SF).toPandas())
    out = mixing.repeated(docs).toPandas()
    words = out.assign(n=[len(WORDS.findall(t)) for t in out.text]).groupby("source").n.sum()
    assert (words == per.taken[per.taken > 0]).all() and list(out.columns) == docs.columns and (out.n_chars == out.text.str.len()).all()
    assert mixing.mix(cases).count() == len(CASES) and mixing.mix(nothing).count() == 0 and mixing.repeated(nothing).count() == 0
    assert mixing.repeated(cases).columns == cases.columns
