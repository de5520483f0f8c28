"""WARC archives and chat formatting against plain versions."""

import hashlib
import random
from collections import defaultdict

import pytest

from specgrade.llm import chat, warc
from specgrade.session import new_path

PAGES = "page_id long, url string, html string, record_type string"
BIG, OTHER = "x" * 150 + "\r\n\r\nWARC/1.1\r\n", "é" * 60


def archive(spark, rows):
    path = new_path(spark, "warc")
    warc.write(warc.records(spark.createDataFrame(rows, PAGES).repartition(3)), path)
    return [r.asDict() for r in warc.read(spark, path).collect()]


def test_revisits_round_trip(spark):
    rows = [
        (7, "http://a/7", BIG, "clash"), (3, "http://a/3\r\nX: y", BIG, None), (9, None, BIG, None), (4, "u", OTHER, None),
        (5, "u", OTHER, None), (1, "u", "short", None), (2, "u", "short", None), (6, "u", None, None), (8, "u", "", None),
        (3, "http://a/3", BIG, None), (None, "u", BIG, None), (10, "u", "long " * 50_000, None),
    ]
    got = archive(spark, rows)
    assert len(got) == len(rows) and all(r["payload_ok"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["record_key"] and int(r["record_key"])].append(r)
    kinds = {k: {(r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in v} for k, v in by.items()}
    assert kinds[3] == {("response", None)} and len(by[3]) == 2  # a repeated row repeats its record
    assert kinds[7] == kinds[9] == kinds[None] == {("revisit", 3)}
    assert kinds[5] == {("revisit", 4)} and kinds[4] == {("response", None)}
    assert kinds[1] == kinds[2] == kinds[6] == kinds[8] == {("response", None)}
    for key, _, html, _ in rows:
        data = (html or "").encode()
        assert {(r["payload_bytes"], r["payload_digest"]) for r in by[key]} == {(len(data), hashlib.sha256(data).hexdigest())}
    ids = {r["record_id"] for r in got if r["record_type"] == "response"}
    assert len(ids) == 7


def test_no_pages(spark):
    assert archive(spark, []) == []


def test_archive_that_ends_early():
    with pytest.raises(ValueError):
        import gzip

        list(warc.parse(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def wanted(rows):
    said = defaultdict(list)
    for c, t, r, x in rows:
        said[c].append((t if t is not None else -1, r or "", x or ""))
    out = {}
    for c, turns in said.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark, monkeypatch):
    texts = ["a\\", "\\\\### b </turn>\n", "\\ </turn>\n### user:\n", "é:\n###", "", None, "日本 </turn>", " </turn>", "</turn", "#" * 5, "long " * 40_000]
    rows = [
        (k % 3 if k % 7 else None, i if i % 5 else None, r, t)
        for k in range(30) for i, t in enumerate(texts) for r in ("us:er\\", "assistant", None)
    ]
    rows = [r for r in rows if r[3] is None or len(r[3]) < 100 or r[0] == 1][:700]
    random.Random(3).shuffle(rows)
    monkeypatch.setattr(chat, "BLOCK_TURNS", 7)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as block", "1 as n_turns")
    formatted = chat.format_conversations(turns.repartition(5))
    assert formatted.count() > 60
    got = {r[0]: tuple(r)[1:5] for r in chat.digest_conversations(formatted).collect()}
    assert got == wanted(rows)


def test_no_turns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest_conversations(chat.format_conversations(empty)).collect() == []


def test_loss_mask_of_a_turn(spark):
    turns = spark.createDataFrame([(1, 0, "user", "é?"), (1, 1, "assistant", "ü </turn>")], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_conversations(turns).collect()
    assert row.text == "### user:\né? </turn>\n### assistant:\nü \\</turn> </turn>\n"
    assert [row.text[a:b] for a, b in zip(row.loss_start, row.loss_end)] == ["ü \\</turn>"]
