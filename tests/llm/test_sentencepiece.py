import hashlib
import random
import struct
from types import SimpleNamespace

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from cytoloom.llm import sentencepiece_codec as codec  # noqa: E402

MODEL = codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
SCHEMA = "doc_id long, text string, ids string, n_tokens int"
ODD = ["", " ", "  a  b ", "\n\n x\n", "▁▁a ▁", "\t\x00z", "é́ ﬁ　ß", "<s> <0x0A> </s>", "a" * 3000, " " * 200 + "x", " \n \n", "🙂🙂 x🙂\n🙂", "the quick brown fox, it's", "ab\r\ncd"]


def texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choices("the of and ing er\n.,▁é🙂", k=rng.randrange(80))) for _ in range(300)]


def test_agenda_is_the_librarys_result():
    own = codec.Codec(MODEL)
    for text, (ids, joined, differing) in zip(texts(), own.encode(texts()), strict=True):
        assert ids == LIBRARY.encode(text) and joined == ",".join(map(str, ids)) and not differing


def test_a_differing_segment_is_found_and_the_library_prevails():
    own = codec.Codec(MODEL)
    own.vocabulary.costs.pop("▁the")
    [(ids, _, differing)] = own.encode(["the weather"])
    assert differing and ids == LIBRARY.encode("the weather")


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(codec, "MEMORY", 3000)
    own = codec.Codec(MODEL)
    for text in texts()[:60]:
        assert own.encode([text])[0][0] == LIBRARY.encode(text)
        assert own.held <= 3000 + sum(codec.weight(s, k) for s, k in own.older.items())


def test_long_segments_are_not_remembered_and_the_memory_counts_bytes(monkeypatch):
    rng = random.Random(7)
    lines = ["".join(rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张", k=1000)) for _ in range(40)]
    own = codec.Codec(MODEL)
    for text, (ids, _, differing) in zip(lines, own.encode(lines), strict=True):
        assert ids == LIBRARY.encode(text) and not differing
    assert own.held < 10_000 and not any(len(s) > codec.LONG for s in own.memory)
    assert own.held == sum(codec.weight(s, k) for s, k in own.memory.items())


def test_a_task_leaves_little_memory_to_the_stages_after_it(monkeypatch):
    monkeypatch.setattr(codec, "CARRIED", 20_000, raising=False)
    batches = [pa.RecordBatch.from_pylist([{"text": t} for t in part]) for part in (texts()[:20], texts(), texts()[:20])]
    own = codec.codec(MODEL)
    docs = SimpleNamespace(sparkSession=None, columns=["text"], schema=SimpleNamespace(fields=[]), mapInArrow=lambda run, _: run)
    monkeypatch.setattr(codec, "ready", lambda _: None)
    task = codec.encode(docs, MODEL)
    assert [x["ids"] for b in task(iter(batches)) for x in b.to_pylist()] == [LIBRARY.encode(t) for t in texts()[:20] + texts() + texts()[:20]]
    assert own.held == len(own.memory) == len(own.older) == 0
    list(task(iter(batches[:1])))
    assert 0 < own.held <= 20_000


def field(number, value):
    """A protocol buffer field: text, score (float) or number under 128."""
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        return bytes([number << 3, value])
    return bytes([number << 3 | 2, len(value)]) + value


def small_model(rng, octets):
    """Pieces of few letters, some with equal scores, some of letters that are no pieces."""
    pieces = {"".join(rng.choices("abc▁", k=1)) for _ in range(3)} | {"▁" * rng.randrange(2) + "".join(rng.choices("abcé", k=rng.randrange(1, 5))) for _ in range(60)}
    rows = [("<unk>", 0.0, codec.UNKNOWN)] + [(f"<0x{k:02X}>", 0.0, codec.BYTE) for k in range(256) if octets]
    rows += [(p, -float(rng.randrange(30)), codec.NORMAL) for p in sorted(pieces)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, score) + field(3, kind)) for p, score, kind in rows)
    return data + field(2, field(3, codec.BPE)) + field(3, field(4, 0))


@pytest.mark.parametrize("seed", range(6))
def test_agendas_abreast_are_the_single_ones(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(codec, "ABREAST", rng.choice([1, 100, 1 << 16]))
    own = codec.Vocabulary(small_model(rng, seed % 2))
    segments = ["▁" * rng.randrange(2) + "".join(rng.choices("aaabbcé🙂\0 ", k=rng.randrange(1, 90))) for _ in range(400)] + ["", "▁", "a"]
    assert own.encode_all(segments) == list(map(own.encode, segments))
    assert own.encode_all([]) == []


def test_only_wide_segments_have_an_agenda_of_their_own(monkeypatch):
    alone = []
    single = codec.Vocabulary.encode
    monkeypatch.setattr(codec.Vocabulary, "encode", lambda self, s: alone.append(s) or single(self, s))
    own = codec.Codec(MODEL)
    for text, (ids, _, differing) in zip(texts(), own.encode(texts()), strict=True):
        assert ids == LIBRARY.encode(text) and not differing
    assert alone and all(len(s) > codec.WIDE for s in alone)


def test_query_and_operator(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts())] + [(900, None, "x", 1), (None, "a", "x", 1), (0, "", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:4]) for r in codec.op7_sentencepiece(docs, MODEL).collect())
    [row] = codec.encode(docs, MODEL).where("doc_id = 6").collect()
    assert row["ids"] == "x" and row["_ids"] == LIBRARY.encode(ODD[6]) and row["decoded"] == ODD[6]
    assert codec.op7_sentencepiece(docs.limit(0), MODEL).collect() == []


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        codec.Vocabulary(b"")
