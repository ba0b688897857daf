"""Operators on texts against plain brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import common, jaccard, language, secrets, suffixes, toxicity
from corvane.llm.bpe import bpe_digests, load
from corvane.llm.packing import CAPACITY, harmonic_packing, pieces
from corvane.llm.suffixes import repeated_starts, suffix_array

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
CLASHES = ["id", "node", "kind", "c1", "c2", "spans", "row", "block", "sequence_id", "score"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


# ------------------------------------------------------------------ byte-level BPE


def test_bpe_equals_tiktoken(spark, docs):
    texts = [None, "", "Hello world, it's 2024!", "a" * 3000, " " * 500 + "x", "ab" * 700, "héllo ẞ ſ 漢字   ½ ²", "Hello world, it's 2024!", "<|endoftext|>"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load(BYTE, public_tokenizers.PATTERN).ranks, special_tokens={})
    rows = {r.doc_id: r for r in bpe_digests(clashing(docs(*texts)), BYTE, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_digests(docs(), BYTE, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------ packing


def test_pieces_cover_a_document():
    for n in range(1, 5000):
        found = pieces(n)
        assert sum(x for x, _ in found) == n
        assert all(k == 0 or CAPACITY // (k + 1) < x <= CAPACITY // k for x, k in found)


def test_packing_is_a_partition_of_all_tokens(docs):
    rng = random.Random(3)
    texts = [None, "", "the cat.", "the cat."] + [" ".join(rng.choice(["alpha", "beta,", "gamma.", "é", "x9"]) for _ in range(rng.randrange(1, 3000))) for _ in range(60)]
    rows = harmonic_packing(clashing(docs(*texts)), WORD).toPandas()
    tokenizer = Tokenizer.from_file(WORD)
    for doc, own in rows.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids)
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    assert set(rows.doc_id) == set(range(len(texts)))
    pad = 0
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= CAPACITY
        n = int(own.length.sum())
        pad += 0 if n & (n - 1) == 0 else CAPACITY - n
    assert pad <= 0.01 * rows.length.sum()
    assert harmonic_packing(docs(), WORD).count() == 0


# ------------------------------------------------------------------ n-gram Jaccard join


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if same and 100 * same >= 80 * union:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))]


def near_copies(rng, n):
    texts = [None, "", " \n ", "one", "One", "a b c d", "a b c d e"]
    passage = [f"p{i}" for i in range(40)]
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    for k in range(n):
        words = list(base) if k % 3 else [f"v{rng.randrange(400)}" for _ in range(60)] + passage
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words[: len(words) - rng.randrange(25)]))
    return texts + texts[-5:]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(docs, seed):
    texts = near_copies(random.Random(seed), 60)
    rows = jaccard.jaccard_components(clashing(docs(*texts))).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(texts)


def test_jaccard_edges(spark, docs):
    assert jaccard.jaccard_components(docs()).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(docs(None, "")).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]
    rows = spark.createDataFrame([(None, "a b c"), (7, "A B C"), (7, "A B C"), (9, "z")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in jaccard.jaccard_components(rows).collect()) == [(-1, 7), (7, 7), (7, 7), (9, 9)]
    assert sorted(r.doc_id for r in jaccard.keep_one(rows).collect()) == [7, 9]


def test_names_of_words_do_not_collide(docs):
    """Words that polynomial hashes modulo a power of two confuse: a Thue-Morse word and its complement."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    texts = [word + " w x y z", word.translate(str.maketrans("ab", "ba")) + " w x y z"]
    rows = jaccard.jaccard_components(docs(*texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(texts)


def test_frequent_shingles_are_met_in_blocks(docs, monkeypatch):
    """Near copies of one text beside it, with n-grams split over groups, blocks and shares, sets in parts."""
    for name, value in (("BLOCK", 7), ("GROUP", 40), ("PAIRS", 30), ("BUCKET", 60), ("HELD", 500), ("COUNTED", 400), ("PART", 16)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = jaccard.jaccard_components(docs(*texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(texts)


def test_keep_one_keeps_unlike_texts_of_one_id(spark):
    rows = [(1, "a b c d e f", "p"), (1, "u v w x y z", "q"), (1, "a b c d e f", "p"), (2, "A b c d e f", "r"), (None, "a b c d e f", "s"), (None, "k l m", "t"), (None, None, "u"), (3, "", "v"), (3, "", "w")]
    out = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, kept_id string"))
    assert sorted(tuple(map(str, r)) for r in out.collect()) == sorted(tuple(map(str, r)) for r in [rows[0], rows[1], *rows[5:]])
    empty = spark.createDataFrame([], "doc_id long, text string, own_t1 string")
    assert jaccard.keep_one(empty).count() == 0 and jaccard.keep_one(empty).columns == empty.columns


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    found = {r.node: r.root for r in jaccard.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert all(found[i] == 0 for i in range(31)) and all(found[i] == 100 for i in range(100, 140)) and found[202] == 200


# ------------------------------------------------------------------ suffixes


def test_suffix_array_is_the_order_of_suffixes():
    rng = np.random.default_rng(5)
    for n in [1, 2, 7, 8, 9, 10, 11, 60, 400]:
        for k in (1, 2, 5, 10**9):
            x = rng.integers(1, k + 1, n)
            assert suffix_array(x).tolist() == sorted(range(n), key=lambda i: x.tolist()[i:])


def test_repeated_starts():
    assert [x.tolist() for x in repeated_starts([b"xxabcdef", b"abcdefg", b"q"], 4)] == [[2, 3, 4], [0, 1, 2], []]


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def brute_dedup(texts):
    return [(*x, y[1]) for x, y in zip(brute_removed(texts, suffixes.LENGTH), brute_removed(texts, suffixes.PASSAGE), strict=True)]


def passages(rng):
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, other = say(700), say(450)
    texts = [None, "", "short", say(2000), say(399)]
    texts += [say(rng.randrange(50, 900)) + shared[rng.randrange(300) :] + say(rng.randrange(300)) + other[: rng.randrange(300, 450)] for _ in range(12)]
    return texts + ["z" * 900, "zy" * 500, texts[5], texts[5], shared + "#" + shared]


def test_suffix_dedup(docs):
    texts = passages(random.Random(11))
    rows = suffixes.suffix_dedup(clashing(docs(*texts))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_dedup(texts)
    assert suffixes.suffix_dedup(docs()).count() == 0


def test_hot_anchors_are_split(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 1)
    rng = random.Random(21)
    texts = passages(rng)
    base = texts[3]
    for _ in range(12):
        at = rng.randrange(len(base))
        texts.append(base[:at] + "XY" + base[at + 1 :])
    rows = suffixes.suffix_dedup(docs(*texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_dedup(texts)


def equal_by_hash():
    """Two unlike strings of 128 bytes whose sums of weights times powers are equal modulo 2^64: four Thue-Morse blocks, their letters chosen by meeting in the middle."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)
    base = int(common._B)
    factor = 1
    for k in range(5):
        factor = factor * (1 - pow(base, 1 << k, 1 << 64)) % (1 << 64)
    free = 64 - ((factor & -factor).bit_length() - 1)
    x, y = (v.ravel() for v in np.meshgrid(letters, letters))
    x, y = x[x != y], y[x != y]
    with np.errstate(over="ignore"):
        delta = common._BYTE[x] - common._BYTE[y]
        power = [np.uint64(pow(base, 32 * m, 1 << 64)) for m in range(4)]
        mask = np.uint64((1 << free) - 1)
        near = (delta[:, None] + power[1] * delta[None, :]).ravel() & mask
        far = (-(power[2] * delta[:, None] + power[3] * delta[None, :])).ravel() & mask
    order = np.argsort(near)
    at = np.minimum(np.searchsorted(near[order], far), len(near) - 1)
    hit = np.flatnonzero(near[order][at] == far)
    i, j = divmod(int(order[at[hit[0]]]), len(x)), divmod(int(hit[0]), len(x))
    turn = [bin(t).count("1") % 2 for t in range(32)]
    one = b"".join(bytes([int(x[k]), int(y[k])][t] for t in turn) for k in (*i, *j))
    two = b"".join(bytes([int(y[k]), int(x[k])][t] for t in turn) for k in (*i, *j))
    return one, two


def test_strings_of_equal_hash_are_not_taken_for_repeats(docs):
    one, two = equal_by_hash()
    assert one != two and common.prefix_hash(np.frombuffer(one, np.uint8))[-1] == common.prefix_hash(np.frombuffer(two, np.uint8))[-1]
    rng = np.random.default_rng(5)
    blocks = rng.integers(97, 123, (40_000, 100), dtype=np.uint8)
    low = min(blocks, key=lambda b: int(common.span_hash(common.prefix_hash(b), np.array([0]), np.array([100]))[0]))
    left, right = rng.integers(97, 123, 200, dtype=np.uint8).tobytes() + low.tobytes(), rng.integers(97, 123, 300, dtype=np.uint8).tobytes()
    texts = [(left + x + right).decode() for x in (one, two)]
    shared = suffixes.repeated_starts([t.encode() for t in texts], 400)
    assert [len(x) for x in shared] == [0, 0]
    rows = suffixes.suffix_dedup(docs(*texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_dedup(texts) and rows[0].n_removed == 0
    kept = suffixes.without_repeats(docs(*texts), length=400).orderBy("doc_id").collect()
    assert [r.text for r in kept] == texts


def test_common_prefixes_are_exact():
    rng = random.Random(31)
    parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 60))) for _ in range(8)]
    pieces = [b"".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(30)] + [b"", b"a" * 300, b"a" * 290]
    for length in (1, 3, 8, 17, 64, 200):
        seen = Counter(x[i : i + length] for x in pieces for i in range(len(x) - length + 1))
        want = [[i for i in range(len(x) - length + 1) if seen[x[i : i + length]] > 1] for x in pieces]
        assert [x.tolist() for x in repeated_starts(pieces, length)] == want


def test_passage_in_many_unlike_texts(docs, monkeypatch):
    """No group of one key holds more than HOT pieces, however many unlike texts have a passage."""
    monkeypatch.setattr(suffixes, "HOT", 20)
    rng, build, made = random.Random(41), suffixes._sorted_fragments, []
    say = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = say(500)
    texts = [say(60) + passage + say(60) for _ in range(200)] + [say(1000)]

    def limited(length):
        run, most = build(length), suffixes.HOT
        made.append(length)

        def checked(pdf):
            assert pdf.groupby("key").size().max() <= most
            return run(pdf)

        return checked

    monkeypatch.setattr(suffixes, "_sorted_fragments", limited)
    rows = suffixes.suffix_dedup(docs(*texts).repartition(4)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_dedup(texts) and made


def test_long_texts_are_cut_into_chunks(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "_STARTS", 512)
    texts = passages(random.Random(12))
    data = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    whole = [suffixes.anchors(d) for d in data]
    assert all(int(w[2].sum()) == max(0, len(d) - suffixes.LENGTH + 1) for w, d in zip(whole, data, strict=True))


def test_without_repeats_keeps_rows_and_columns(docs):
    texts = passages(random.Random(13))
    rows = clashing(docs(*texts))
    out = suffixes.without_repeats(rows)
    assert out.columns == rows.columns and out.count() == len(texts)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[0] is None and kept[2] == "short" and kept[3] == texts[3]


# ------------------------------------------------------------------ secrets


def brute_base(text):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, k, pattern, least in (("access", 1, "AKIA[A-Z0-9]+", 20), ("hex", 2, "[0-9a-f]+", 24)):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [x[2] for x in sorted(out)]


SECRETS = [
    None, "", "no secrets", "𝒳 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and 𝒴", "token=token:abcdefgh Password:  'hunter22' api_key=abc", "AKIA" + "Z9" * 8 + " AKIAAKIA AKIAAKIA" + "B" * 20,
    "key q7Rt0xZp3LmNb8Vc2Kd5Ws9Ya1 then thanbleshaningtionntandmore", "sha256-q7Rt0xZp3LmNb8Vc2Kd5Ws9Ya1 example-q7Rt0xZp3LmNb8Vc2Kd5Ws9Ya1", "DEADBEEF0123ABCD4567EF89", "deadbeef" * 9, "a" * 5000 + " 0123456789abcdef0123456789abcdef",
]


def test_secret_base_spans(docs):
    rows = secrets.secret_scan(clashing(docs(*SECRETS))).collect()
    for r in rows:
        base = brute_base(SECRETS[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))


def test_secret_entropy_spans(docs):
    found = {r.doc_id: r.spans for r in secrets.secret_scan(docs(*SECRETS)).collect()}
    assert found[6] == "entropy_base64:4:30" and found[7] == "" and found[8] == "entropy_hex:0:24"


def test_redaction(docs):
    kept = {r.doc_id: r.text for r in secrets.redact(clashing(docs(*SECRETS))).collect()}
    assert kept[0] is None and kept[2] == "no secrets" and kept[3] == '𝒳 [SECRET]" and 𝒴' and kept[6] == "key [SECRET] then thanbleshaningtionntandmore"
    assert secrets.redact(docs()).count() == 0


def test_secrets_of_very_long_texts(spark):
    """A candidate of 200,000 characters, 20,000 matches and 20,000 candidates beside base spans, each in seconds."""
    rng = random.Random(1)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    texts = [say(200_000), " ".join(f"é token = abcdef{i}" for i in range(20_000)), " ".join(say(25) for _ in range(20_000)), " ".join(f"secret={say(24)} {say(24)}." for _ in range(5_000))]
    for i, text in enumerate(texts):
        d = spark.createDataFrame([(i, text)], "doc_id long, text string")
        began = time.time()
        row = secrets.secret_scan(d).first()
        base = brute_base(text)
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in row.spans.split(",")]
        want = sorted((int(a), int(b)) for _, a, b in spans)
        kept = secrets.redact(d).first().text
        merged, at, out = [], 0, []
        for a, b in want:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            out += [text[at:a], "[SECRET]"]
            at = b
        assert kept == "".join([*out, text[at:]])
        assert time.time() - began < 60


def test_entropy_equals_windows_counted_from_scratch(docs):
    rng = random.Random(3)
    texts = ["".join(rng.choice(rng.choice(["abcdef0123456789", "ab1", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"])) for _ in range(rng.randrange(15, 70))) for _ in range(300)]
    rows = {r.doc_id: r.spans for r in secrets.secret_scan(docs(*texts)).collect()}
    for i, text in enumerate(texts):
        base = brute_base(text)
        want = set(base)
        for m in re.finditer(secrets.CANDIDATE, text):
            kind = next((c for c in secrets.CLASSES if re.search(c[1], m[0]) and re.search(c[2], m[0])), None)
            inside = any(int(x.split(":")[1]) <= m.start() and m.end() <= int(x.split(":")[2]) for x in base)
            if kind is None or inside or any(re.search(p, m[0]) for p in secrets.ALLOWED):
                continue
            least = min(sum(round(c * math.log2(c) * (1 << 16)) for c in Counter(m[0][j : j + 20]).values()) for j in range(len(m[0]) - 19))
            if least <= secrets.most_sum(kind[3]):
                want.add(f"{kind[0]}:{m.start()}:{m.end()}")
        assert set(rows[i].split(",")) - {""} == want, text


def test_redact_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "token=abcdefgh", "p", "q"), (None, None, "r", "s"), (1, "", "t", "u")], "doc_id long, text string, base_spans string, all_spans string")
    out = secrets.redact(rows)
    assert out.columns == rows.columns and {tuple(r) for r in out.collect()} == {(1, "[SECRET]", "p", "q"), (None, None, "r", "s"), (1, "", "t", "u")}


# ------------------------------------------------------------------ toxicity and language


def labelled(rng, n):
    words, bad = [f"w{rng.randrange(500)}" for _ in range(300)], ["zonkish", "grumpled"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = " ".join(rng.choice(words) for _ in range(60)) + (" " + rng.choice(bad) + " " if toxic else " ") + " ".join(rng.choice(words) for _ in range(9))
        docs.append((i, text))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(random.Random(2), 400)
    docs += [(None, "hello"), (1000, None), (1001, ""), (1002, "hi")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(clashing(d), y).toPandas()
    assert len(rows) == len(docs) and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    own = rows[rows.doc_id.between(0, 399)]
    assert (own.held_out == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in own.doc_id]).all()
    held = own[own.held_out]
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.95


def test_toxicity_equals_brute_force(spark, monkeypatch):
    """Document counts, log-count ratios, the fit's input and every score recomputed from the texts, gram by gram."""
    monkeypatch.setattr(toxicity, "LEAST_DOCS", 2)
    docs, labels = labelled(random.Random(8), 120)
    docs += [(500, None), (501, "hey"), (502, "Zonkish ZONKISH"), (502, "w1"), (None, "zonkish w2")]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (4, 1), (7, 2)], "doc_id long, toxic int")
    want = {i: t for i, t in labels if i != 4} | {4: 1}
    want = {i: t for i, t in want.items() if zlib.crc32(str(i).encode()) % 5}
    grams = {}
    for i, text in docs:
        points = "".join(max(c, " ") for c in (text or "").lower())
        grams.setdefault(i, []).append({int(h) for n in toxicity.SIZES for h in one_gram_hashes(points, n)})
    n = [sum(t == k for t in want.values()) for k in (0, 1)]
    counts = [Counter(), Counter()]
    for i, t in want.items():
        counts[t].update(grams[i][0])
    ratio = {}
    for h in set(counts[0]) | set(counts[1]):
        r = math.log((counts[1][h] + 1) / (n[1] + 2)) - math.log((counts[0][h] + 1) / (n[0] + 2))
        if counts[0][h] + counts[1][h] >= 2 and abs(r) >= toxicity.LEAST_RATIO:
            ratio[h] = r
    model = toxicity.train(d.select(F.col("doc_id").alias("id"), "text"), y.select(F.col("doc_id").alias("id"), "toxic"))
    assert set(np.flatnonzero(model.weights).tolist()) <= set(ratio)
    whole = np.zeros(1 << toxicity.BITS)
    whole[list(ratio)] = list(ratio.values())
    order = sorted(want)
    weight = np.array([toxicity.TOXIC_WEIGHT if want[i] else 1.0 for i in order])
    again = toxicity.fit([np.array(sorted(grams[i][0]), np.uint32) for i in order], np.array([want[i] for i in order]), weight, whole, n[1] / sum(n))
    assert np.allclose(model.weights, again.weights, atol=1e-4) and abs(model.bias - again.bias) < 1e-4
    rows = toxicity.toxicity(clashing(d), y).collect()
    assert len(rows) == len(docs)
    found = sorted((str(r.doc_id), round(r.score, 4)) for r in rows)
    plain = lambda own: 1 / (1 + math.exp(-(again.bias + sum(float(again.weights[h]) for h in own))))
    assert [x[0] for x in found] == sorted(str(i) for i, _ in docs)
    for (_, got), expected in zip(found, sorted((str(i), plain(own)) for i, each in grams.items() for own in each), strict=True):
        assert abs(got - expected[1]) < 2e-3


def one_gram_hashes(text, n):
    """The hash of each n-gram, from its characters one at a time."""
    m = (1 << 32) - 1
    for i in range(len(text) - n + 1):
        h = sum(ord(c) * pow(0x9E3779B1, k + 1, 1 << 32) for k, c in enumerate(text[i : i + n])) & m
        x = (h ^ h >> 15) * 0x85EBCA6B & m
        yield ((x ^ x >> 13) * 0x9E3779B1 & m) >> 32 - toxicity.BITS


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs("a", None), none).collect()} <= {0, 1}
    assert toxicity.toxicity(docs(), none).count() == 0


def sayings(rng):
    words = {"en": ["the", "and", "with", "this", "house", "water"], "fr": ["le", "des", "avec", "cette", "maison", "était"], "de": ["der", "und", "mit", "diese", "häuser", "wasser"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k, f"s{i % 3}", 1) for i, k in enumerate(list(words) * 40)]
    return rows + [(900, None, "en", "s0", 0), (901, "", None, None, 0), (902, "12 34 !!", "en", "s1", 8), (903, "cette maison", None, None, 1), (903, "cette maison", None, None, 1)]


LANGUAGE_CLASHES = ["row", "logs", "host", "domain", "declared", "suffix", "found", "found_lang", "posterior"]
PAGES = "page_id long, url string, html string"


def test_language_of_documents(spark):
    rows = sayings(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("x").alias(c) for c in LANGUAGE_CLASHES])
    kept = language.in_known_languages(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(120), 903, 903] and kept.filter("host = 'x'").count() == 122
    found = {r.doc_id: r.detected for r in language.document_languages(docs, language.known_languages(docs), keep=["doc_id"]).collect()}
    assert all(found[i] == k for i, _, k, _, _ in rows[:120])
    assert found[900] == found[901] == found[902] == "und" and found[903] == "fr"


def brute_language(known, texts, hosts, domains, said, usual):
    """Every step of the fusion in plain Python, one row at a time: (language, posterior)."""
    names, n = known.languages, len(known.languages)
    logs = [known.of(t) for t in texts]
    soft = []
    for x in logs:
        up = [0.0] * n if x is None else [math.exp(v - max(x)) for v in x]
        soft.append([v / sum(up) if x is not None else 0.0 for v in up])
    out = []
    for i, x in enumerate(logs):
        if x is None:
            out.append(("und", None))
            continue
        prior = [(1 - language.UNKNOWN_PRIOR) / (n - 1)] * (n - 1) + [language.UNKNOWN_PRIOR]
        near = lambda j: (True, domains[j] == domains[i], domains[j] == domains[i] and hosts[j] == hosts[i])
        for level, weight in enumerate((50.0, *language.SMOOTHING)):
            counts = [sum(soft[j][k] for j in range(len(texts)) if near(j)[level] and j != i) for k in range(n)]
            prior = [(c + weight * p) / (sum(counts) + weight) for c, p in zip(counts, prior, strict=True)]
        z = [v + math.log(p + 1e-12) for v, p in zip(x, prior, strict=True)]
        for word, trust in ((said[i], language.DECLARED_TRUST), (usual[i], language.SUFFIX_TRUST)):
            if word in names[:-1]:
                z = [v + math.log(trust if name == word else (1 - trust) / (n - 1)) for v, name in zip(z, names, strict=True)]
        up = [math.exp(v - max(z)) for v in z]
        out.append((names[z.index(max(z))], max(up) / sum(up)))
    return out


def test_language_id_equals_brute_force(spark):
    """Documents and pages with nulls, empties, repeats and clashing columns, against the fusion recomputed."""
    docs = sayings(random.Random(6))
    rng = random.Random(7)
    words = ["der", "und", "le", "des", "the", "water", "maison", "häuser"]
    pages = [(i, f"http://{rng.choice(['a.site.de', 'b.site.de', 'x.org', 'y.co.uk', 'localhost'])}/p", rng.choice(["", '<html lang="de">', "<HTML lang=fr-FR>", "<html lang='xx'>"]) + "<p>" + " ".join(rng.choice(words) for _ in range(rng.randrange(4))) + "</p>") for i in range(60)]
    pages += [(5, None, "<p>und der wasser</p>"), (None, "http://a.site.de", None), (61, "no url", ""), (61, "no url", "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("x").alias(c) for c in LANGUAGE_CLASHES])
    p = spark.createDataFrame(pages, PAGES).select("*", *[F.lit("x").alias(c) for c in LANGUAGE_CLASHES])
    known = language.known_languages(d)
    rows = language.language_id(d, p).collect()
    blank = [None] * len(docs)
    want = [("document", r[0], None, *x) for r, x in zip(docs, brute_language(known, [r[1] for r in docs], [r[3] or "" for r in docs], blank, blank, blank), strict=True)]
    hosts = [re.search("://([^/?#:]*)", u or "")[1] if "://" in (u or "") else "" for _, u, _ in pages]
    said = [m[1].lower() if (m := re.search("(?i)<html[^>]*lang=[\"']?([a-z]{2})", h or "")) else None for _, _, h in pages]
    visible = [None if h is None else re.sub("<[^>]*>", " ", h) for _, _, h in pages]
    found = brute_language(known, visible, hosts, [".".join(h.split(".")[-2:]) for h in hosts], said, [language.SUFFIXES.get(h.split(".")[-1]) for h in hosts])
    want += [("page", None, r[0], *x) for r, x in zip(pages, found, strict=True)]
    key = lambda x: tuple(str(v) if not isinstance(v, float) else f"{v:.6f}" for v in x)
    assert sorted(key((r.kind, r.doc_id, r.page_id, r.detected, r.posterior)) for r in rows) == sorted(key(x) for x in want)
    assert all(r.kept == (r.detected != "und") for r in rows)


def test_language_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], PAGES)
    assert language.language_id(docs(), none).count() == 0 and language.in_known_languages(docs()).count() == 0
    assert language.language_id(docs("the house"), none).count() == 1
    assert [r.detected for r in language.language_id(docs(), spark.createDataFrame([(1, "http://a.de", "<p>und der</p>")], PAGES)).collect()] == ["und"]


def test_groups_do_not_grow_with_copies(docs):
    """A thousand copies are one node: no pairs, one component."""
    rows = jaccard.jaccard_components(docs(*["a b c d e f g"] * 1000)).groupBy("component_id").count().collect()
    assert [tuple(r) for r in rows] == [(0, 1000)]

