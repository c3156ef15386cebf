"""Stores of blobs against a plain walk over all windows, chats by hand."""

import base64
import hashlib
import json
import random

from tracelode.operators import blobs as B
from tracelode.plans.blobs import child_blobs

SCHEMA = "key string, value binary"


def digest(x) -> bytes:
    return hashlib.sha256(str(x).encode()).digest()


def plain(store):
    """(live keys, number of unreadable rows) by looking at every window of 32 bytes."""
    blobs = {bytes.fromhex(k[len(B.BLOB) :]): v for k, v in store if k and k.startswith(B.BLOB) and len(k) == len(B.BLOB) + 64}
    windows = lambda raw: {raw[i : i + 32] for i in range(len(raw) - 31)} & blobs.keys()
    bad, queue, contents = 0, [], set()

    def decoded(text):
        try:
            body = text.removeprefix("~").translate(str.maketrans("-_", "+/"))
            return base64.b64decode(body, validate=True)
        except ValueError:
            return None

    for k, v in store:
        if k is None or v is None or k.startswith(B.BLOB):
            continue
        at = v.find(B.CONTENT.encode())
        while at >= 0:
            contents.add(v[at : at + len(B.CONTENT) + 64].decode("latin-1"))
            at = v.find(B.CONTENT.encode(), at + 1)
        if k.startswith(B.POINTERS):
            raw = decoded(v.decode().strip())
            if raw is None or len(raw) != 32:
                bad += 1
            elif raw in blobs:
                queue.append(raw)
        elif k.startswith(B.STATES):
            try:
                state = json.loads(v).get("conversationState")
            except ValueError:
                continue
            if state:
                raw = decoded(state)
                bad += raw is None
                queue += windows(raw or b"")
    live = set()
    while queue:
        one = queue.pop()
        if one in live:
            continue
        live.add(one)
        if blobs[one] is None:
            bad += 1
        else:
            queue += windows(blobs[one])
    return {B.BLOB + x.hex() for x in live} | {k for k, _ in store if k in contents}, bad


def some_store(rng, n, damaged):
    ids = [digest(rng.random()) for _ in range(n)]
    noise = lambda most: rng.randbytes(rng.randrange(most))
    store = []
    for i, one in enumerate(ids):
        refs = [rng.choice(ids) if rng.random() < 0.7 else digest("unknown") for _ in range(rng.randrange(4))]
        value = noise(40) + b"".join(r + noise(rng.choice([1, 30])) for r in refs)
        store.append((B.BLOB + one.hex(), None if damaged and rng.random() < 0.2 else value))
        if i % 6 == 0:
            state = base64.urlsafe_b64encode(noise(9) + one[: rng.choice([31, 32, 32])]).decode()
            store.append((f"composerData:{i}", json.dumps({"conversationState": "~" + state}).encode()))
        if i % 9 == 0:
            store.append((f"agentKv:checkpoint:{i}", b" " + base64.b64encode(one[: 20 if damaged and i == 9 else 32]) + b"\n"))
        if i % 4 == 0:
            store.append((B.CONTENT + one.hex(), b"content"))
            store.append((f"other:{i}", noise(9).replace(b"c", b"") + (B.CONTENT + rng.choice(ids).hex()).encode() + b"ff"))
    return store + [(None, b"x"), (B.BLOB + "ab", ids[0]), ("bubbleId:x", b"{no json"), ("bubbleId:y", None), ("bubbleId:z", b'{"conversationState": ""}')]


def test_sweep_equals_a_plain_walk(spark):
    rng = random.Random(5)
    for damaged in (False, True):
        store = some_store(rng, 60, damaged)
        live, bad = plain(store)
        df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in store], SCHEMA)
        rows = B.sweep(df).collect()
        assert {r.key for r in rows if r.live} == live
        assert len(rows) == 75 and {r.bytes for r in rows if r.kind == "content"} == {7}
        assert [r.deletable for r in rows] == [not r.live and not bad for r in rows]
        assert B.unreadable(df, B.live(df)).count() == bad


def test_sweep_of_nothing(spark):
    assert B.sweep(spark.createDataFrame([], SCHEMA)).collect() == []
    assert B.sweep(spark.createDataFrame([("composerData:a", bytearray(b'{"conversationState": "AAAA"}'))], SCHEMA)).collect() == []


def test_windows_at_borders_of_strides(spark, monkeypatch):
    monkeypatch.setattr(B, "STRIDE", 64)
    ids = [digest(i) for i in range(3)]
    raw = b"\0" * 50 + ids[0] + b"\0" * 14 + ids[1] + ids[0] + b"\0" + ids[2]
    rows = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(raw[:81])), ("c", None)], "key string, raw binary")
    got = B.windows_among(rows, spark.createDataFrame([(x.hex(),) for x in ids], "id string")).collect()
    assert sorted((r.key, r.id) for r in got) == sorted(("a", x.hex()) for x in ids)


def test_chat_of_odd_messages(spark):
    message = lambda role, content: json.dumps({"role": role, "content": content}).encode()
    blobs = {
        "m0": message("user", [{"type": "text", "text": "a"}, {"type": "text", "text": "<user_info>x"}, {"type": "text", "text": " <user_query> </user_query>"}]),
        "m1": b"\xff\xfe", "m2": None, "m3": message("user", "<environment_context> <user_query>q</user_query>"), "m4": message("user", " <additional_data>"),
        "m5": message("assistant", [{"type": "tool-result", "toolCallId": "c", "result": None}, {"type": "tool-call", "toolName": 5}, {"type": "image"}]), "m6": message("assistant", None), "m7": b'{"content": []}',
    }
    name = lambda k: digest(k).hex()
    order = ["m4", "m0", "m1", "m2", "none", "m3", "m0", "m5", "m6", "m7"]
    root = b"".join(b"\x0a\x20" + digest(k) for k in order)
    rows = [("s", name(k), None if v is None else bytearray(v)) for k, v in blobs.items()] + [("s", "root", bytearray(root)), ("t", name("m0"), bytearray(b"{}"))]
    heads = spark.createDataFrame([("s", "root"), ("t", "gone"), ("u", None)], "session string, root string")
    got = B.chat_events(spark.createDataFrame(rows, "session string, id string, data binary"), heads, child_blobs("data")).orderBy("message", "part").collect()
    first = [("meta", ""), ("user", "a\n\n <user_query> </user_query>")]
    assert [(r.message, r.role, r.text) for r in got] == [
        (0, "meta", " <additional_data>"), *[(1, *x) for x in first], (5, "user", "<environment_context> <user_query>q</user_query>"), *[(6, *x) for x in first],
        (7, "tool_result", ""), (7, "tool_call", ""), (8, "assistant", ""),
    ]
    assert [r.call for r in got if r.message == 7] == ["c", None]
