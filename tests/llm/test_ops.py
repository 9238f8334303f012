"""The ten operators on small tables: brute-force twins, and nulls, empty and long texts, ties, repeats, extra columns."""

import contextlib
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import connection, of_duckdb, of_spark
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import bitsliced, chat, decontam, mixing, neardup, queries, repeats, ring, tokens, toxicity, warc
from framelake.llm.arrowtext import buffers

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
ODD = [None, "", " ", "\x00", "é" * 3, "<|endoftext|> x", "a", "w " * 30_000]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size int, mark string, score string, key string"


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or [None, "a", "b"])[i % len(sources or [0, 0, 0])], 0, "s", 1, "m", "x", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    df = documents(spark, ODD + ODD)
    return df.unionByName(df.limit(3)).unionByName(df.limit(2).withColumn("doc_id", F.lit(None).cast("long")))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(name, spark, sf):
    assert of_spark(queries.QUERIES[name](spark, sf)) == of_duckdb(connection(sf), queries.ORACLES[name])


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_are_the_library_s(spark, sf, odd):
    lib = library()
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet").limit(60)):
        texts = Counter((r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        out = tokens.token_counts(df).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in out) == texts
        assert all(r.over_limit == (r.n_tokens > 2048) for r in out)
    assert tokens.token_counts(odd.limit(0)).count() == 0


def test_counts_of_prefixes():
    c, lib = tokens.counter("word_bpe_49k.json"), library()
    hard = ["it's i'd we'll 's", "áb é́ x̀ ", "<|endoftext|> hi<|endoftext|>x", "\x1cq\x1d z\x85y\xa0z k", "12345 a1b2 ###!! 你好"]
    for text in hard + ["".join(rng.choice(hard)[:6] for _ in range(4)) for _ in range(15)]:
        assert c.count(text) == len(lib.encode(text, add_special_tokens=False).ids)
        each = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert [c.at(text, i) for i in range(len(text) + 1)] == each
        if "<" not in text:
            for budget in range(each[-1] + 1):
                i = c.within(text, budget)
                assert each[i] <= budget and (i == len(text) or each[i + 1] > budget or text[i].isspace())


def test_cuts_are_exact_to_the_character():
    c = tokens.counter("word_bpe_49k.json")
    text = "字" * 700 + "。" + "word" * 100
    for budget in (0, 1, 5, 300, 700):
        i = c.within(text, budget)
        assert c.encoded(text[:i]) <= budget < c.encoded(text[: i + 1])
    calls, encoded = [], c.encoded
    c.encoded = lambda t: calls.append(t) or encoded(t)
    try:
        again = "some plain words, and more of them"
        assert [c.at(again, i) for i in range(len(again))] and not calls  # rows of prefixes answer, no encoding
    finally:
        del c.encoded


def test_rows_of_prefixes_are_the_library_s():
    """Dynamic programming against encoding each prefix, for words of any length and script."""
    c, lib = tokens.counter("word_bpe_49k.json"), library()
    pool = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "etaoinshr", "éàüßñçø", "日本語漢字", "абвгд", "!?#$%^&*-=", "aB́ǅΣς") for n in (1, 2, 7, 20, 60)]
    for part in [*pool, "antidisestablishmentarianism" * 12, "İstanbul", "internationalization", "a" * 700]:
        each = [len(e.ids) for e in lib.encode_batch([part[:j] for j in range(1, len(part) + 1)], add_special_tokens=False)]
        if len(c._parts(part)) == 1 and c._parts(part)[0][1] == part:
            assert c._row(part) == [0, *each], part


def test_vocabularies_that_keep_white_space_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        tokens.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


def test_chat_reads_back(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "\\", "\\\\</turn>\n### user\n", "###", "line\nline\\n", "日本 </turn>", "x" * 50_000]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 5)):
            rows.append((c if c else None, t, rng.choice(["user", "assistant", "system", "a:b\n\\n", None]), rng.choice(texts), 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted([(t, role or "", text or "") for k, t, role, text, _ in rows if k == c])
        said, loss = "".join(f"{r}\n{t}\n" for _, r, t in own), "".join(t for _, r, t in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = chat.digests(chat.formatted(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == want
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_mask_is_found_by_search():
    spans, toks = np.array([[3, 7], [9, 9], [10, 12]]), np.array([[0, 2], [2, 4], [4, 6], [6, 8], [8, 11], [11, 14]])
    assert chat.under_mask(spans, toks).tolist() == [[1, 4], [4, 5], [4, 6]]


def test_mix_comes_near_its_targets(spark, odd):
    texts = [prose(rng.choice([1, 5, 50, 300])) for _ in range(900)]
    df = documents(spark, texts, [None, "a", "a", "b", "c", "c", "c", "d"])
    out = mixing.mixed(df).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, live, left = {}, set(order), 1.5 * sum(sizes.values())
    while live:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        full = {s for s in live if share[s] > 2 * sizes[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        live -= full
    taken = defaultdict(int)
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size) and abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in order)
    again = {(r.doc_id, r.mark): r.taken for r in mixing.mixed(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.mark): r.taken for r in out}
    assert mixing.mix(df).count() == sum(r.copies for r in out) and mixing.mix(df).columns == df.columns
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(odd.limit(0)).count() == 0


def test_landing_comes_near_where_few_documents_are_taken_or_left():
    size = np.sort(np.random.default_rng(2).choice([1.0, 5.0, 50.0, 300.0], 225))[::-1]
    for seed, p in enumerate([0.01, 0.99, 0.5] * 8):
        ends = mixing._flight(np.full(len(size), p), size, np.random.default_rng(seed), True)
        assert set(ends) <= {0, 1} and abs(ends @ size - p * size.sum()) <= 2


def test_flight_in_levels_keeps_the_sums(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    df = documents(spark, [prose(rng.randint(1, 40)) for _ in range(400)], ["a", "b"])
    taken, goal = defaultdict(int), {}
    for r in mixing.mixed(df).collect():
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 20 for s in goal)


def test_archives_round_trip(spark):
    html = [None, "", "", "<p>a</p>", "<p>a</p>", "é" * 3000, "b\r\n\r\nc"] + [prose(200) for _ in range(40)]
    rows = [(i, None if i % 5 == 0 else f"http://x/{i}", h, "d") for i, h in enumerate(html)] + [(3, "http://x/again", "<p>a</p>", "d"), (None, None, "lone", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    archives = warc.write(df)
    out = warc.read_back(archives).collect()
    assert len(out) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    by = defaultdict(list)
    for r in out:
        by[r.page_id].append(r)
    for i, _, h, _ in rows[: len(html)]:
        r = by[i][0] if i != 3 else min(by[3], key=lambda r: r.record_type)
        assert (r.payload_bytes, r.payload_digest) == (len((h or "").encode()), warc.base32_sha1((h or "").encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    assert sorted(r.record_type for r in by[3]) == ["response", "revisit"]
    strange = ["http://x/a\r\nX-Page-Id: 7", "http://x/ b", "\x7f\t", "http://x/é", ""]
    urls = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(strange)], "page_id long, url string, html string")
    assert {r.page_id: r.url for r in warc.read_back(warc.write(urls)).collect()} == dict(enumerate(strange))
    assert warc.write(urls).first().content[:4] == b"\x5d\x2a\x4d\x18"  # too little to train on: the samples serve
    content = archives.first().content
    assert content[:4] == b"\x5d\x2a\x4d\x18" and content[8:12] == b"\x37\xa4\x30\xec"
    assert all(r.record_type == "response" for r in warc.read_back(warc.write(df, min_revisit_bytes=10**9)).collect())
    assert warc.read_back(warc.write(df.limit(0))).count() == 0


def brute_repeats(texts):
    raw, n = [(t or "").encode() for t in texts], repeats.LENGTH
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        out.append((len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [512, 3])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    shared, base = prose(110), prose(300)
    texts = [prose(120) + " " + shared + " " + prose(90) for _ in range(9)] + [base, base, base[:900] + "X" + base[900:], base[50:]]
    texts += [shared[:399], shared[:400], "a" * 1500, "ab" * 500, None, "", "é" * 250, prose(40) + base[100:499], prose(40) + base[100:501]]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(documents(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_repeats(texts)
    assert repeats.without_repeats(documents(spark, texts).limit(0)).count() == 0


def brute_passages(texts):
    """Whether 50 words in a row also stand in another text."""
    grams = [{tuple(w[i : i + 50]) for i in range(len(w) - 49)} for w in ((t or "").split() for t in texts)]
    held = Counter(g for own in grams for g in own)
    return [any(held[g] > 1 for g in own) for own in grams]


def test_passages_of_fifty_words_are_found_across_documents(spark):
    short = " ".join(rng.choice(["a", "of", "the", "to", "in"]) + str(rng.randint(0, 9)) for _ in range(60))
    far = [prose(70) for _ in range(3)]
    texts = [prose(40) + " " + short + " " + prose(30) for _ in range(4)] + [short.replace(" ", "\n\t"), prose(9) + " " + short[:-3]]
    texts += [" ".join(short.split()[:49]) + " " + prose(200), " ".join(short.split()[11:]) + "x " + prose(30), " ".join(short.split()[10:])]
    texts += [prose(30) + " " + " ".join(far[k].split()[:n]) + " " + prose(30) for k, n in ((0, 70), (0, 50), (1, 70), (1, 49))]
    texts += [far[2] + " " + prose(20) + " " + far[2], prose(300), "w " * 500, None, "", "one"]
    assert len(short.encode()) < repeats.LENGTH
    out = {r.doc_id: r for r in repeats.without_repeats(documents(spark, texts)).collect()}
    assert [out[i].shares_passage for i in range(len(texts))] == brute_passages(texts)
    assert [out[i].n_removed for i in range(len(texts))] == [x[1] for x in brute_repeats(texts)]


def test_suffix_array_is_sorted():
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(400, 500))) for _ in range(4)] + [b"ab" * 300]
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size) - size
    text, ends = np.frombuffer(b"".join(pieces), np.uint8), np.repeat(begin + size, size)
    order, _ = repeats.suffix_array(text, ends)
    key = [bytes(text[i : min(ends[i], i + repeats.LENGTH)]) for i in order]
    assert key == sorted(key)


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[0-9a-z]+", (t or "").lower())
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    return out


def test_near_duplicates_against_brute_force(spark):
    base = [prose(150) for _ in range(12)]
    texts = list(base)
    for t in base[:8]:
        w = t.split()
        for cuts in (1, 2, 6, 12):
            v = list(w)
            for i in rng.sample(range(len(v)), cuts):
                v[i] = rng.choice(WORDS)
            texts.append(" ".join(v))
    texts += [base[0], base[1].upper(), base[2] + " " + base[3], "one two", "one two", "solo", None, None, "", ""]
    sets = shingle_sets(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 or texts[i] == texts[j] == "":
                parent[find(i)] = find(j)
    want = {i: min(j for j in range(len(texts)) if find(j) == find(i)) for i in range(len(texts))}
    df = documents(spark, texts)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want
    assert sorted(r.doc_id for r in neardup.one_of_each(df).collect()) == sorted(set(want.values()))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def brute_force_classes(texts):
    """Class by least place, over all pairs, by the weighted similarity that the operator defines."""
    sets = [Counter() if t is None else shingle_counts(t) for t in texts]
    df = Counter(x for s in sets for x in s)
    weigh = [{x: (1 + np.log(c)) * (1 + round(255 * min(np.log(len(texts) / df[x]), np.log(100)) / np.log(100)) / 255) for x, c in s.items()} for s in sets]
    total = [sum(w.values()) for w in weigh]
    label, near = list(range(len(texts))), {}
    for i in range(len(texts)):
        for j in range(i):
            common = sum(min(v, weigh[j][x]) for x, v in weigh[i].items() if x in weigh[j])
            near[i, j] = common / (total[i] + total[j] - common) if common else 0.0
            if near[i, j] >= 0.8 - 1e-9:
                label = [min(label[i], label[j]) if c in (label[i], label[j]) else c for c in label]
    return label, near


def shingle_counts(text):
    w = re.findall(r"[a-z0-9]+", text.lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def near_the_border(rng, kinds=40):
    """Texts with common passages and repeated shingles, whose copies lie on both sides of a similarity of 0.8."""
    common, texts = " ".join(rng.choice(WORDS) for _ in range(80)), []
    for _ in range(kinds):
        own = [rng.choice(WORDS) for _ in range(150)]
        own += own[20:40]
        texts.append(" ".join(own) + " " + common)
        for cuts in (1, 3, 4, 5, 6, 8):
            v = list(own)
            for i in rng.sample(range(len(v)), cuts):
                v[i] = rng.choice(WORDS)
            texts.append(" ".join(v) + (" " + common if rng.random() < 0.7 else ""))
    return rng.sample(texts, len(texts))


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_against_weighted_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = near_the_border(random.Random(5))
    want, near = brute_force_classes(texts)
    assert sum(0.7 < x < 0.8 for x in near.values()) > 30 and sum(0.8 <= x < 0.9 for x in near.values()) > 30
    out = {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert out == dict(enumerate(want))


def test_rows_of_one_id_and_other_kinds_of_ids(spark):
    a, b = prose(60), prose(60)
    df = spark.createDataFrame([(1, a), (1, b), (5, b), (7, a), (None, a), (None, prose(20)), (1, a)], "doc_id long, text string")
    out = [(r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()]
    of_a = {c for d, c in out if d == 7}
    of_b = {c for d, c in out if d == 5}
    assert len(out) == 7 and of_a | of_b > {1} and len(of_a | of_b) == 2 and sum(c in of_a for _, c in out) == 4 and sum(c in of_b for _, c in out) == 2
    kept = neardup.one_of_each(df).collect()
    assert {r.text for r in kept} > {a, b} and len(kept) == 3
    named = neardup.near_duplicates(df.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()
    assert len({r.class_id for r in named}) == 3 and len(named) == 7


def test_links_across_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(3)
    parts, texts = [" ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(60)], []
    for _ in range(150):  # two of a kind are near duplicates, different kinds are not; all hold common passages only
        own = sorted(rng.sample(range(60), 42))
        less = sorted(rng.sample(own, 38))
        texts += [" ".join(parts[k] for k in own), " ".join(parts[k] for k in less)]
    order = rng.sample(range(300), 300)
    out = {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, [texts[i] for i in order])).collect()}
    kinds = defaultdict(list)
    for doc, i in enumerate(order):
        kinds[i // 2].append(doc)
    assert out == {d: min(v) for v in kinds.values() for d in v}


def test_links_of_a_block_are_a_forest_of_its_classes():
    rng = random.Random(9)
    texts = near_the_border(rng, 12)
    from framelake.llm.arrowtext import buffers

    data, at = buffers(pa.array(texts))
    row, h, count = neardup.shingles(data, at)
    w = 1 + np.log(count)
    ends = np.searchsorted(row, np.arange(1, len(texts) + 1))
    n = len(texts)
    sets = [dict(zip(h[a:b].tolist(), w[a:b].tolist())) for a, b in zip(np.append(0, ends), ends)]
    common = lambda x, y: sum(min(v, y[k]) for k, v in x.items() if k in y)
    near = {(i, j) for i in range(n) for j in range(i) if (c := common(sets[i], sets[j])) >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - c)}

    def classes(pairs):
        label = list(range(n))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i in range(n) if label[i] == x) for x in label}

    out = neardup.links_of_block(h, w, ends, np.arange(n), np.zeros(n, int), 0.8)
    assert len(out) < n and classes(out) == classes(near) and all((max(p), min(p)) in near for p in out)
    side = np.arange(n) % 2
    out = neardup.links_of_block(h, w, ends, np.arange(n), side, 0.8)
    assert classes(out) == classes([p for p in near if side[p[0]] != side[p[1]]])


def test_consistent_samples_estimate_weighted_jaccard():
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64))
    a, b = h[:2000], h[600:]
    wa, wb = np.where(np.arange(len(a)) % 2, 1.0, 3.0), np.full(len(b), 2.0)
    both = dict(zip(a.tolist(), wa, strict=True))
    common = sum(min(both[x], 2.0) for x in b.tolist() if x in both)
    true = common / (wa.sum() + wb.sum() - common)
    row = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
    s = neardup.sketches(row, np.concatenate([a, b]), np.concatenate([wa, wb]), 2)
    assert abs((s[0] == s[1]).mean() - true) < 0.1 and (s != 0).all()


def test_agreement_follows_weights_where_shingles_are_few():
    draw = np.random.default_rng(11)
    found = []
    for _ in range(400):  # 160 common shingles of weight 2, 62 more of weight 1.2 on one side: 320 of 394.4
        h = draw.integers(0, 1 << 63, 222).astype(np.uint64)
        w = np.where(np.arange(222) < 160, 2.0, 1.2)
        s = neardup.sketches(np.repeat([0, 1], [160, 222]), np.concatenate([h[:160], h]), np.concatenate([w[:160], w]), 2)
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - 320 / 394.4) < 0.012 and np.mean(np.array(found) > 0.8 - 3 * (0.16 / neardup.SLOTS) ** 0.5) > 0.99


def test_toxicity_learns_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fitted(docs, labels)
    some = docs.join(F.broadcast(labels), "doc_id").where(toxicity.held_out())
    out = toxicity.scored(some, model, ["doc_id", "toxic"]).collect()
    pos, neg = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    auc = np.mean([[p > n for n in neg] for p in pos])
    assert auc > 0.95 and np.mean([p >= 0.3 for p in pos]) > 0.85 and np.mean([n >= 0.3 for n in neg]) < 0.05
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4) == 2 for r in out)


def test_few_toxic_rows_give_a_threshold_by_the_same_rule():
    rng = random.Random(4)
    y = np.array([1] * 24 + [0] * 300)
    bad_words = "vilezor grumbax snorvik".split()
    toxic = lambda: " ".join(w for _ in range(10) for w in (prose(3), rng.choice(bad_words)))
    texts = [toxic() if c else prose(40) for c in y]
    model = toxicity.train(texts, y, ["en"] * len(y), np.ones(len(y)))
    fresh = [toxic() for _ in range(30)] + [prose(40) for _ in range(30)]
    bad = toxicity._judged(model, pa.array(fresh), pa.array(["en"] * 60))[1]
    assert model.threshold < 0.9 and bad[:30].mean() > 0.8 and bad[30:].mean() < 0.2


def test_toxicity_of_odd_rows(spark, sf, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.fitted(odd, labels.limit(0)) is None
    texts = [prose(20) + (" vile scum" if i % 3 == 0 else "") for i in range(120)]
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fitted(documents(spark, texts), marks)
    same = toxicity.kept(odd, model)
    assert same.columns == odd.columns and same.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in toxicity.scored(odd, model, ["doc_id"]).collect())
    assert toxicity.scored(odd.limit(0), model, ["doc_id"]).count() == 0


def test_scores_against_a_plain_forward_pass(spark):
    texts = [prose(k) + (" vile scum" if k % 3 == 0 else "") for k in (1, 3, 30, 64, 65, 200)] * 4 + ["", None, "!!", "a"]
    marks = spark.createDataFrame([(i, int(i % 3 == 1)) for i in range(len(texts))], "doc_id long, toxic int")
    df = documents(spark, texts)
    m = toxicity.fitted(df, marks)
    for r in toxicity.scored(df, m, ["doc_id"]).collect():
        words = re.findall("[a-z0-9]+", (texts[r.doc_id] or "").lower())
        raw = [np.frombuffer(w.encode(), np.uint8) for w in words]
        name = lambda b: int(toxicity.Rolling(b).of(np.array([0]), np.array([len(b)]))[0])
        part = lambda b, p: (name(b[:p]) + p) % (1 << 64)
        x = [sum(m.table[h % (toxicity.BUCKETS - 1) + 1].astype(float) for h in [name(b), *(part(b, p) for p in toxicity.PREFIXES)]) for b in raw]
        x += [np.zeros(toxicity.WIDTH)] * toxicity.GAP
        stretches = []
        for lo in range(0, len(raw), toxicity.STRETCH):
            # a text's last stretch also looks at the empty rows that end it
            last = min(lo + toxicity.STRETCH, len(raw)) if lo + toxicity.STRETCH < len(raw) else len(raw) + toxicity.GAP
            own = []
            for w, kernel in m.kernels.items():
                y = [sum((x[i + o] if i + o < len(x) else np.zeros(toxicity.WIDTH)) @ kernel[o] for o in range(w)) for i in range(lo, last)]
                own += list(np.maximum(np.max(y, axis=0) + m.biases[w], 0))
            stretches.append(own)
        f = sum(toxicity.FILTERS.values())
        features = np.concatenate([np.max(stretches, axis=0), np.mean(stretches, axis=0)]) if stretches else np.zeros(2 * f)
        z = m.scale[0] * (features @ m.out + m.bias) + m.scale[1]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 2e-3, (r.doc_id, len(words))


def test_sample_takes_whole_texts_within_its_bound(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", {0: 4000, 1: 3000})
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, y, langs, weights, **how: seen.update(texts=texts, y=y))
    texts = [prose(40) + (" tail" if i % 2 else "") for i in range(100)] + ["long " * 2000 + "end"]
    marks = spark.createDataFrame([(i, i % 2) for i in range(101)] * 2, "doc_id long, toxic int")
    toxicity.fitted(documents(spark, texts).unionByName(documents(spark, texts[:30])), marks)
    assert set(seen["texts"]) <= set(texts[:100]) and len(set(seen["y"])) == 2
    assert len(seen["texts"]) == len(set(seen["texts"])) >= 16  # what no longer fits is passed over, rows count once

    for c in (0, 1):
        own = [len(t) for t, y in zip(seen["texts"], seen["y"]) if y == c]
        assert 2000 < sum(own) <= (4000, 3000)[c]


def test_all_labelled_rows_are_learned(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", {0: 5, 1: 5})
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", {0: 300, 1: 300})
    texts = [prose(20) + (" vile scum" if i % 3 == 0 else "") for i in range(400)] + ["long " * 2000, "", None]
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(403)] * 2 + [(None, 1), (7, None)], "doc_id long, toxic int")
    docs = documents(spark, texts).unionByName(documents(spark, texts[:50]))
    due = sorted((texts[i] or "", int(i % 3 == 0)) for i in range(403) if zlib.crc32(str(i).encode()) % 4 != 2)
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, y, *_, **how: seen.update(whole=sorted(zip(texts, y.tolist()))))
    monkeypatch.setattr(toxicity, "_in_parts", lambda held, rounds: seen.update(parts=held.collect()))
    assert queries.QUERIES["op7_toxicity"] and toxicity.trained(docs, marks) is None and seen["whole"] == due
    monkeypatch.setattr(toxicity, "ALONE_BYTES", 0)
    monkeypatch.setattr(toxicity, "PART_BYTES", 8000)
    toxicity.trained(docs, marks)
    assert sorted((r.text, r.toxic) for r in seen["parts"]) == due and len({r.part for r in seen["parts"]}) > 4


def test_labelled_texts_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ALONE_BYTES", 0)
    monkeypatch.setattr(toxicity, "PART_BYTES", 8000)
    monkeypatch.setattr(toxicity, "_in_parts", lambda held, rounds: None)
    plans, staged = [], toxicity.staged

    def seen(df, name):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("formatted")
        plans.append(out.getvalue())
        return staged(df, name)

    monkeypatch.setattr(toxicity, "staged", seen)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for labels that are too many to be sent to all tasks
    try:
        toxicity.trained(documents(spark, [f"word{i} " * 20 for i in range(400)]), marks)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[[^\n]*\btext#", plans[0])) == 1


def test_queries_learn_from_no_sample(spark, sf, monkeypatch):
    def sampled(*_):
        raise AssertionError("a sample")

    monkeypatch.setattr(toxicity, "fitted", sampled)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert queries.QUERIES["op7_toxicity"](spark, sf).count() == docs.count()
    assert 0 < corpus_pipeline.drop_toxic(spark, docs, sf).count() <= docs.count()


def test_models_of_many_parts_learn_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ALONE_BYTES", 0)
    monkeypatch.setattr(toxicity, "PART_BYTES", 3 << 20)
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.trained(docs, labels)
    some = docs.join(F.broadcast(labels), "doc_id").where(toxicity.held_out())
    out = toxicity.scored(some, model, ["doc_id", "toxic"]).collect()
    pos, neg = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.95 and np.mean([p >= 0.3 for p in pos]) > 0.85 and np.mean([n >= 0.3 for n in neg]) < 0.05
    assert set(model.thresholds) <= {r.lang for r in docs.select("lang").distinct().collect()} and len(model.thresholds) == 4


def test_parts_are_averaged_where_they_changed():
    def learner(rows, by, bias):
        model = toxicity._fresh(np.random.default_rng(1))
        model.table[rows] += by
        model.bias = bias
        return model, {"m": {}, "v": {"table": np.isin(np.arange(toxicity.BUCKETS), rows).astype(np.float32)}, "n": 3}

    old = [(toxicity._fresh(np.random.default_rng(1)), {"m": {}, "v": {}, "n": 0})]
    one = toxicity._changed(0, old, [learner([5, 70], 0.5, 1.0)], [30])
    two = toxicity._changed(1, old, [learner([70, 5000], 0.25, 4.0)], [10])
    rows = sorted(one.to_pylist() + two.to_pylist(), key=lambda r: (r["model"], r["block"], r["part"]))
    means = {r["block"]: r["data"] for b in toxicity._averaged(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()}
    first = np.frombuffer(means[0]).reshape(toxicity.BLOCK, -1)
    assert set(means) == {-1, 0, 4} and np.allclose(first[[5, 70, 6], 0], [0.5, 0.375, 0], atol=1e-3) and first[5, -1] == first[70, -1] == 1
    assert np.allclose(np.frombuffer(means[4]).reshape(toxicity.BLOCK, -1)[5000 % toxicity.BLOCK, 0], 0.25, atol=1e-3)
    model, state = learner([], 0, 0.0)
    toxicity._set_dense(model, state, np.frombuffer(means[-1]))
    assert np.isclose(model.bias, (30 * 1 + 10 * 4) / 40)


def test_null_and_empty_are_languages(spark):
    texts = [prose(30) + (" vile scum" if i % 3 == 0 else "") for i in range(240)]
    langs = [(None, "", "en")[i % 4 % 3] for i in range(240)]
    model = toxicity.train(texts, np.array([int(i % 3 == 0) for i in range(240)]), langs, np.ones(240))
    assert set(model.thresholds) == {None, "", "en"}
    model.threshold, model.thresholds = 0.5, {None: 1.1, "": -1.0}
    assert toxicity._judged(model, pa.array(["x", "x", "x"]), pa.array([None, "", "en"]))[1].tolist()[:2] == [False, True]


def test_scores_do_not_depend_on_the_next_text():
    texts = [prose(30) + (" vile scum" if i % 3 == 0 else "") for i in range(120)]
    model = toxicity.train(texts, np.array([int(i % 3 == 0) for i in range(120)]), ["en"] * 120, np.ones(120))
    alone = [float(toxicity._judged(model, pa.array([t]), pa.array(["en"]))[0][0]) for t in texts[:40]]
    together = toxicity._judged(model, pa.array(texts[:40]), pa.array(["en"] * 40))[0]
    assert np.allclose(alone, together, atol=1e-5)


def walked(rows, shards, nodes):
    """Rows (doc_id, text) one by one: {row number: (shard, slot)}, by a sequential walk of the ring."""
    place = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:12], 16)
    points = sorted((place(f"{i % shards}:{i // shards}"), i % shards) for i in range(shards * nodes))
    arcs = defaultdict(list)
    for k, (doc, text) in enumerate(rows):
        p = place(text or "")
        arcs[next((i for i, (at, _) in enumerate(points) if p <= at), 0)].append(k)
    ways = {i: list(dict.fromkeys(points[(i + d) % len(points)][1] for d in range(len(points)))) for i in arcs}
    cells = max(1, -(-len(rows) // ring.CELL_ROWS))
    key = lambda k: (lambda tie: (tie % cells, tie, rows[k][0], len((rows[k][1] or "").encode()) + 1, zlib.crc32((rows[k][1] or "").encode())))(place(f"tie:{rows[k][0]}"))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    left, filled, out = {i: sorted(own, key=key) for i, own in arcs.items()}, [0] * shards, {}
    for r in range(shards):
        for i in sorted(arcs):
            s = ways[i][r]
            taken, left[i] = left[i][: room[s]], left[i][room[s] :]
            room[s] -= len(taken)
            for k in taken:
                out[k] = (s, filled[s])
                filled[s] += 1
    return out


@pytest.mark.parametrize("cell", [2048, 16])
def test_shards_against_a_sequential_walk(spark, monkeypatch, cell):
    monkeypatch.setattr(ring, "CELL_ROWS", cell)
    texts = [prose(5) for _ in range(200)] + ["same"] * 150 + [None, "", "é" * 9]
    want = walked(list(enumerate(texts)), ring.SHARDS, ring.VIRTUAL_NODES)
    assert {r.doc_id: (r.shard, r.slot) for r in ring.sharded(documents(spark, texts)).collect()} == want


def test_shards_are_even_and_stable(spark, odd):
    df = documents(spark, [prose(5) for _ in range(500)] + ["same"] * 300)
    out = ring.sharded(df).collect()
    per = Counter(r.shard for r in out)
    assert max(per.values()) - min(per.values()) <= 1 and len(out) == 800
    for s in per:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(per[s]))
    assert all(r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) for r, t in ((r, df_text) for r in out for df_text in [texts_of(df)[r.doc_id]]))
    grown = ring.sharded(df, law="key").collect()
    assert all(r.grown_shard in (r.shard, ring.SHARDS) for r in grown) and any(r.grown_shard == ring.SHARDS for r in grown)
    placed = ring.with_shards(odd)
    assert placed.count() == odd.count() and set(placed.columns) == set(odd.columns) | {"slot"}
    assert ring.sharded(odd.limit(0)).count() == 0


def texts_of(df, cache={}):
    if id(df) not in cache:
        cache[id(df)] = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    return cache[id(df)]


def test_planted_passages_are_found(spark):
    items = [prose(40) for _ in range(20)]
    texts, want = [], set()
    for i in range(60):
        host, s = prose(200), list(items[i % 20])
        if i % 3 == 0:
            texts.append(host)
            continue
        for _ in range(i % 3 * decontam.edits(len(s)) // 4):
            p = rng.randrange(len(s))
            s[p] = rng.choice("xyz")
        cut = rng.randint(0, len(host))
        texts.append(host[:cut] + " " + "".join(s).upper() + "\n " + host[cut:])
        want.add((i, i % 20))
    bench = spark.createDataFrame([*((i, t, 0) for i, t in enumerate(items)), (90, None, 0), (91, "", 0), (92, "tiny", 0)], "item_id long, text string, start int")
    df = documents(spark, texts)
    found = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    for r in found:
        region = texts[r.doc_id].encode()[r.start : r.end].decode()
        assert abs(len(region) - len(items[r.item_id])) <= decontam.edits(len(items[r.item_id])) + 2
    clean = decontam.decontaminated(df, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(60) if i % 3 == 0] and clean.columns == df.columns
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def least_edits(item, text):
    """Of item and any stretch of text, letter by letter."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_contamination_against_brute_force(spark):
    items = [prose(k) for k in (3, 4, 6, 10, 20, 30)] + ["tiny", "a b", "Word!", "no", "?!"]
    plain = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
    texts = [prose(12) for _ in range(20)] + ["a b", "so tiny a thing", "atiny", "word, no", "nothing", "tiny", "", None]
    for i in range(90):
        s = list(items[i % 6])
        for _ in range(rng.randint(0, int(0.14 * len(s)))):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice([[], [rng.choice("abc")], [rng.choice("xyz"), s[p]]])
        texts.append(prose(rng.randint(0, 9)) + " " + "".join(s) + " " + prose(rng.randint(0, 9)))
    want = set()
    for i, t in enumerate(map(plain, texts)):
        for k, it in enumerate(map(plain, items)):
            if len(it) >= decontam.Q and least_edits(it, t) <= decontam.edits(len(it)) or 0 < len(it) < decontam.Q and f" {it} " in f" {t} ":
                want.add((i, k))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(documents(spark, texts), bench).collect()}
    assert found == want and any(k >= 6 for _, k in want) and len(want) > 40
    long = prose(300)  # an item that starts before the text
    assert decontam.contaminated(documents(spark, [long + " end", prose(30)]), spark.createDataFrame([(1, "start of it " + long)], "item_id long, text string")).count() == 1


def test_index_in_pieces_finds_the_same(spark, odd, monkeypatch):
    items = [prose(30) for _ in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = documents(spark, [prose(50) + " " + items[i % 6] for i in range(12)]).unionByName(odd)
    whole = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    monkeypatch.setattr(decontam, "INDEX_CHARS", 300)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()} == whole and len(whole) == 12


def test_contaminated_rows_are_dropped_where_they_lie(spark, odd, monkeypatch):
    """No document is shuffled or sorted; several pieces of index drop the same rows."""
    own = random.Random(31)
    line = lambda n: " ".join(own.choice(WORDS) for _ in range(n))
    items = [line(30) for _ in range(6)] + ["tiny"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = documents(spark, [line(50) + (" " + items[i % 7] if i % 2 else "") for i in range(28)] + ["tiny", "atiny", "", None]).unionByName(odd)
    df = corpus_pipeline.staged(df, "test")
    bad = [(r.doc_id, r.mark) for r in decontam.contaminated(df, bench).select("doc_id", "mark").distinct().collect()]
    marked = df.withColumn("hash", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    want = sorted(map(str, (r[:-1] for r in marked.collect() if (r.doc_id, r.hash) not in bad)))
    clean = decontam.decontaminated(df, bench)
    assert sorted(map(str, map(tuple, clean.collect()))) == want and len(want) == df.count() - 15
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Sort" not in plan
    assert sorted(map(str, map(tuple, decontam.decontaminated(df, bench.limit(0)).collect()))) == sorted(map(str, map(tuple, df.collect())))
    monkeypatch.setattr(decontam, "INDEX_CHARS", 300)
    assert sorted(map(str, map(tuple, decontam.decontaminated(df, bench).collect()))) == want


def test_alignment_counts_edits():
    def row(s):
        return np.frombuffer(s.encode(), np.uint8)

    assert decontam.aligned(row("kitten"), row("my sitting cat"), 3)[2] == 2
    assert decontam.aligned(row("kitten"), row("dog"), 2) is None


def test_band_is_the_whole_table():
    """Regions found in a band of diagonals have the edits that the whole table gives, wherever the region starts in it."""
    letters = "abcdefgh "
    for n in range(200):
        m = rng.randint(20, 120)
        item = "".join(rng.choice(letters) for _ in range(m))
        k = rng.randint(0, m // 8)
        near = list(item)
        for _ in range(rng.randint(0, k)):
            at = rng.randrange(len(near))
            near[at : at + 1] = rng.choice(["", rng.choice(letters), near[at] + rng.choice(letters)])
        before = rng.randint(0, 40)
        text = "".join(rng.choice(letters) for _ in range(before)) + "".join(near) + "".join(rng.choice(letters) for _ in range(n % 30))
        found = decontam.aligned(*(np.frombuffer(x.encode(), np.uint8) for x in (item, text)), k, before - k - 3, before + k + 4)
        row = list(range(m + 1))
        least = row[m]
        for c in text:
            last, row = row, [0]
            for i, x in enumerate(item, 1):
                row.append(min(last[i] + 1, row[i - 1] + 1, last[i - 1] + (x != c)))
            least = min(least, row[m])
        assert found is not None and found[2] == least <= k
        assert abs(found[1] - found[0] - m) <= k


def test_long_items_are_aligned_quickly():
    import time

    item = np.frombuffer(rng.randbytes(20_000), np.uint8)
    text = np.concatenate([item[:5000], item[5003:12_000], np.zeros(40, np.uint8), item[12_000:]])
    began = time.process_time()
    assert decontam.aligned(item, text, decontam.edits(len(item)))[2] == 43
    assert time.process_time() - began < 4


def test_regions_of_common_items_stay_apart():
    many = [(0, 0, 10 * i, 10 * i + 9, i % 3) for i in range(20_000)] + [(0, 0, 10 * i + 5, 10 * i + 14, 5) for i in range(20_000)]
    assert len(decontam._apart(many)) == 20_000


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "ROWS", 64)
    monkeypatch.setattr(bitsliced, "QUERIES", 2)
    g = np.random.default_rng(2)
    x = [list(map(float, np.float32(v))) for v in g.normal(0, 0.1, (300, 16))]
    x[7], x[8], x[9], x[10], x[11] = None, [None] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, x[12]
    x[20:40] = [x[20]] * 20
    df = spark.createDataFrame([(i, v, "c") for i, v in enumerate(x)], "vec_id long, embedding array<float>, score string")
    q = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in enumerate(x) if v and None not in v and np.isfinite(v).all()}
    want = []
    for i in (i for i in q if i % 100 == 0):
        best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:10]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    out = bitsliced.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, out)) == sorted(want)
    assert bitsliced.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    big = spark.createDataFrame([(100, [1e30, 2.0]), (1, [2e30, 1.0]), (2, [-1e30, 0.5]), (3, [1.0, 1.0]), (4, [5e12, 1.0]), (5, [5e12, 1.0])], "vec_id long, embedding array<double>")
    top = [(r.rank, r.vec_id) for r in bitsliced.top_k(big, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert top == [(1, 1), (2, 3), (3, 4), (4, 5), (5, 2)]  # the first four scores exceed a long


def test_slices_of_large_numbers_give_exact_scores():
    x = np.array([[1 << 62, -5], [-(1 << 62), 7], [3, 4], [(1 << 62) - 1, 9]])
    own = bitsliced.BitSlices.of(np.arange(4), x)
    own = bitsliced.BitSlices.read(*own.stored())
    assert own.exact([1 << 62, 3]) == [sum(int(a) * b for a, b in zip(r, (1 << 62, 3), strict=True)) for r in x]
    assert [i for i, _ in own.top(np.array([1 << 62, 3]), 4, 2)] == [0, 3, 1] and own.top(np.array([1 << 62, 3]), 1, 2)[0][1] == (1 << 63) - 1


def test_buffers_of_slices_and_nulls():
    a = pa.array(["ab", None, "", "é"])
    data, at = buffers(a.slice(1, 3))
    assert bytes(data) == "é".encode() and at.tolist() == [0, 0, 0, 2]
