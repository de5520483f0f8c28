"""Personal data, fingerprints, mixing and packing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specgrade.llm import merkle, mixing, packing, pii

DOCS = "doc_id long, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    "a@b.com@c.de x.y_a@b.comx_y@z.com", "a@b@c.de", "1.2.3.4.5.6.7.8 999.1.2.3.4 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1111x4111111111111111",
    "+1 (555) 010-9999. +1+12345678901 +123456789012345678", "é+49 30 1234567890 émail@x.y.z", "1" * 40 + " 5 4111111111111111", None, "",
    "a.@b-.c. 00255.1.1.0 256.1.1.1", "4111111111111111 5", "5-4111111111111111", "4111111111111111" + " x" * 50_000 + " +4930123456789",
]


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}.get(name)
            if all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else good:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], DOCS))
    got = {r.doc_id: r for r in pii.summary(docs).collect()}
    for doc_id, text in docs.collect():
        spans, r = base_spans(text or ""), got[doc_id]
        joined = ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == n for s in spans) for n in PATTERNS]


def test_added_kinds_and_redaction(spark):
    rows = [
        (1, "IBAN GB82 WEST 1234 5698 7654 32, wrong GB83 WEST 1234 5698 7654 32"), (2, "call (555) 123-4567 now"), (3, "part (555) 123-4567 now"),
        (4, "his SSN 123-45-6789"), (5, "item 123-45-6789"), (6, None), (6, None), (7, "x@y.zz"),
    ]
    df = spark.createDataFrame(rows, DOCS).withColumn("pii", F.lit(1))
    cleaned = pii.redact(df)
    assert cleaned.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in cleaned.collect()], key=str) == sorted(
        [
            (1, "IBAN [IBAN], wrong GB83 WEST 1234 5698 7654 32"), (2, "call [LOCAL_PHONE] now"), (3, "part (555) 123-4567 now"),
            (4, "his SSN [SSN]"), (5, "item 123-45-6789"), (6, None), (6, None), (7, "[EMAIL]"),
        ],
        key=str,
    )
    near, far = (r.pii[0].score for r in pii.find(spark.createDataFrame([(1, "mail x@y.zz"), (2, "x@y.zz")], DOCS)).orderBy("doc_id").collect())
    assert near > far
    assert pii.summary(df.limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [4_000, 20])
def test_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", bucket)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-3, None), (10_000, "\n"), (10_001, "long text.\n" * 30_000), (10_002, "")], DOCS))
    got = {r.doc_id: r for r in merkle.fingerprints(docs.withColumn("edited", F.lit(0))).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    prints = defaultdict(set)
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert all(len(p) == 1 for p in prints.values()) and len({p for s in prints.values() for p in s}) == len(prints)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (2, ""), (2, "x. y"), (2, "x. y")], DOCS)
    assert merkle.fingerprints(df).count() == 5
    (alone,) = merkle.fingerprints(df.where("text = ''")).collect()
    assert (alone.near_edited, alone.near_next, alone.n_chars) == (1.0, 1.0, 0)
    assert merkle.fingerprints(df.limit(0)).collect() == []
    (row,) = spark.range(1).select(merkle.differing_paragraphs(F.lit("a\nb\nccc\nd"), F.lit("a\nccc\nx")).alias("d")).collect()
    assert [tuple(x) for x in row.d] == [(1, 2, 3), (3, 8, 9)]


def rows_of_sources():
    rng = random.Random(1)
    return [(i, "big" if i % 3 == 0 else f"s{i % 7}", rng.randrange(0, 400)) for i in range(3_000)]


MIX = "doc_id long, source string, n long"


@pytest.mark.parametrize("bucket", [2_000, 25])
def test_mixture_meets_its_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rows = rows_of_sources()
    df = spark.createDataFrame(rows, MIX).withColumn("mix_block", F.lit("clash")).repartition(4)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    total = sum(sizes.values())
    share = {s: n / total for s, n in sizes.items()}

    def entropy(a):
        z = sum(p**a for p in share.values())
        w = [p**a / z for p in share.values()]
        return -sum(x * math.log(x) for x in w)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.99 * math.log(len(share)) else (low, mid)
    z = sum(p**low for p in share.values())
    got = mixing.mix(df, F.col("n"), evenness=0.99, block_tokens=20_000).collect()
    used, blocks = Counter(), defaultdict(Counter)
    for r in got:
        used[r.source] += r.n
        blocks[r.mix_block][r.source] += r.n
    for s, p in share.items():
        assert 0 <= p**low / z * total - used[s] < 400  # less than one row short of the budget
    last = max(blocks)
    assert all(abs(blocks[b]["big"] / sum(blocks[b].values()) - share["big"] ** low / z) < 0.05 for b in range(last))
    assert len({(r.doc_id, r.mix_epoch) for r in got}) == len(got)
    again = mixing.mix(df.repartition(3), F.col("n"), evenness=0.99, block_tokens=20_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_every_row_at_least_once_up_to_the_limit(spark):
    rows = rows_of_sources()
    got = mixing.mix(spark.createDataFrame(rows, MIX), F.col("n"), max_repeats=1.5, keep_all=True).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    times, have = Counter(), Counter()
    for r in got:
        times[r.source] += r.n
    for _, s, n in rows:
        have[s] += n
    ratio = {s: times[s] / have[s] for s in have}
    assert ratio["big"] == 1 and max(ratio.values()) == pytest.approx(1.5, abs=0.02) and max(ratio.values()) <= 1.5


def test_mixture_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "a", 0), (None, "b", 5), (None, "b", 5)], MIX)
    assert Counter(r.source for r in mixing.mix(df, F.col("n"), keep_all=True).collect()) == Counter([None, "a", "b", "b"])
    assert mixing.mix(df.limit(0), F.col("n"), evenness=0.9).collect() == []
    assert mixing.mix(df.where("n = 0"), F.col("n")).count() == 2


def free_spaces(lengths, capacity):
    space = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in space if s >= n]
        if fits:
            space.remove(min(fits))
            space.append(min(fits) - n)
        else:
            space.append(capacity - n)
    return sorted(space)


@pytest.mark.parametrize("capacity", [1, 7, 64, 90])
@pytest.mark.parametrize("seed", range(5))
def test_plan_equals_best_fit_decreasing(capacity, seed):
    rng = random.Random(1000 * seed + capacity)
    histograms = [Counter({30: 4}), Counter({4: 3, 10: 5, 34: 2, 15: 7, 56: 9, 16: 9})] if capacity >= 64 else []
    for _ in range(60):
        few = rng.sample(range(1, capacity + 1), min(capacity, rng.choice([2, 6, 40])))
        histograms.append(Counter(rng.choice(few) for _ in range(rng.randint(0, 200))))
    for counts in histograms:
        lengths = list(counts.elements())
        rows = packing.plan(counts, capacity).tolist()
        cells = [(s + k, x) for n, _, s, m, at in rows for k in range(m) for x in range(at, at + n)]
        assert len(cells) == len(set(cells)) == sum(lengths)
        used = Counter(s for s, _ in cells)
        assert all({x for t, x in cells if t == s} == set(range(n)) for s, n in list(used.items())[:5])  # gapless
        assert sorted(capacity - n for n in used.values()) == free_spaces(lengths, capacity)
        for length in counts:  # ranks are numbered without gaps
            assert sorted(r + k for n, r, _, m, _ in rows if n == length for k in range(m)) == list(range(counts[length]))


def test_packing(spark):
    folder, capacity = "/root/testdata/sf0.001", 200
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (None, "null key"), (-3, "twice"), (-3, "twice"), (-4, "<|endoftext|>")], DOCS))
    got = packing.pack_documents(docs.withColumn("length", F.lit("clash")), public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc_id, text in docs.collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        start, piece = 0, 0
        while start < len(ids):
            end = start + ((len(ids) - start) % capacity or capacity)
            data = b"".join(i.to_bytes(4, "little") for i in ids[start:end])
            want[doc_id, piece, start, end - start, zlib.crc32(data)] += 1
            start, piece = end, piece + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == free_spaces([r.length for r in got], capacity)
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), capacity).collect() == []


def test_added_tokens_inside_texts_have_their_own_ids(spark):
    from specgrade.llm.queries import TOKENIZER

    end = "<|endoftext|>"
    texts = [
        f"hello {end} world", end, end * 3, f"{end} {end}", f"a{end}b", f"a  {end}  b", f" {end}\n\n{end} ", f"it's{end}'s", "<|endoftext|", f"<{end}>", "é日本 🙂" + end + "é",
    ]
    folder = "/root/testdata/sf0.001"
    texts += [t for (t,) in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect() if t]
    texts += [t[: len(t) // 2] + end + t[len(t) // 2 :] for t in texts[-50:]]
    oracle = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in oracle.encode_batch(texts, add_special_tokens=False)]
    assert packing.encoder(TOKENIZER)(texts) == want
    assert want[0] == [31373, 220, 50256, 995]
    (row,) = packing.pack_documents(spark.createDataFrame([(1, texts[0])], DOCS), TOKENIZER).collect()
    assert (row.length, row.ids_crc32) == (5, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*want[0], 0])))


def test_tokenizer_files_that_ranks_cannot_follow(tmp_path):
    import json

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = json.load(open(path))
    whole["added_tokens"][0]["lstrip"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(whole))
    text = "hello <|endoftext|> world"
    want = Tokenizer.from_file(str(other)).encode(text, add_special_tokens=False).ids
    assert packing.encoder(str(other))([text]) == [want] and want != packing.encoder(path)([text])[0]


def test_likeness_in_any_script_order_and_number(spark):
    halves = {
        "repeated": ("wort " * 400, "other words here " * 100), "russian": ("съешь ещё этих мягких французских булок да выпей чаю", "широкая электрификация южных губерний даст мощный толчок"),
        "chinese": ("今天天气很好。我们一起去公园散步。晚上回家吃饭。", "这本书讲述了一个古老的故事。作者生活在南方。"), "no spaces": ("abcdefghij" * 30, "zyxwvutsrq" * 30),
        "consonants": ("string length growth thing myth " * 5, "north south depth width " * 8),
    }
    rows = []
    for name, (text, other) in halves.items():
        half = len(text) // 2
        rows += [(name, text, text[: len(text) - half] + other[:half], 0.2, 0.8), (name, text, text, 1.0, 1.0), (name, text, other, 0.0, 0.1)]
    lines = [f"line number {i} says {i * i}" for i in range(40)]
    rows += [("reordered", "\n".join(lines), "\n".join(reversed(lines)), 0.3, 0.99), ("more often", "same line\n" * 10, "same line\n" * 90, 0.05, 0.4), ("empty", "", "x", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "name string, a string, b string, low double, high double")
    marks = df.select("*", merkle.piece_marks(F.col("a")).alias("x"), merkle.piece_marks(F.col("b")).alias("y"))
    for r in marks.select("name", "low", "high", merkle.likeness(F.col("x"), F.col("y")).alias("like"), F.size("x").alias("n"), F.size(F.array_distinct("x")).alias("k")).collect():
        assert r.low <= r.like <= r.high, r
        assert r.n == r.k


def test_first_half_counts_in_every_longer_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 40")
    assert merkle.fingerprints(docs).where("near_edited <= 0").count() == 0
