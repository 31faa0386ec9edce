import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import arrowfiles as A
from tessella.llm import packing as P
from tessella.llm.tokens import WordEncoder, encoder, vocabulary_path


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sltd.,!12éß漢🙂\x1c\x85\xa0ªº_<|>")), st.characters(codec="utf-8")), max_size=60))
def test_word_by_word_ids_are_the_library_ids(text):
    assert encoder(vocabulary_path()).encode(text).tolist() == library_ids([text])[0]


def test_added_tokens_are_the_library_ids(spark):
    texts = ["<|endoftext|>", "a<|endoftext|>b", "one two <|endoftext|> three", " <|endoftext|><|endoftext|>\n x", "<|endoftext|", "<|ENDOFTEXT|>", "漢 <|endoftext|>\x85 end", "word <|endoftext|> " * 2000]
    e = WordEncoder(vocabulary_path())
    want = library_ids(texts)
    assert want[0] == [50256] and [e.encode(t).tolist() for t in texts] == want
    docs = list(enumerate(texts))
    got = P.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces_of(docs))


def test_a_full_memory_changes_nothing(monkeypatch):
    import tessella.llm.tokens as tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    e, r = WordEncoder(vocabulary_path()), random.Random(0)
    texts = [" ".join(r.choice(["alpha", "beta,", "gamma\n", "delta.", "e" * 90, "zeta", "eta", "theta"]) for _ in range(30)) for _ in range(20)]
    assert [e.encode(t).tolist() for t in texts] == library_ids(texts)


def test_arrow_query_matches_the_library(spark, data, documents):
    docs = sorted((r.doc_id, r.text) for r in documents.collect())
    want, at = [], 0
    for (i, _), ids in zip(docs, library_ids([t for _, t in docs]), strict=True):
        want.append((i, at, len(ids) + 1, crc([*ids, 2])))
        at += len(ids) + 1
    assert sorted(map(tuple, A.op9_arrow_files(spark, data).collect())) == want


def test_shard_round_trip(tmp_path):
    r = np.random.default_rng(0)
    docs = [(i, r.integers(0, 50_000, int(n))) for i, n in enumerate([1, 7, 0, 300, 64, 5])] + [(None, np.array([9]))]
    w = A.ShardWriter(f"file://{tmp_path}", "s", A.id_type(50_257), length=16, batch=2)
    for i, ids in docs:
        w.add(i, ids.astype(np.uint32).tobytes())
    w.close()
    shard = A.ShardReader(f"file://{tmp_path}", "s")
    flat = np.concatenate([ids for _, ids in docs])
    assert [d[0] for d in shard.documents()] == [i for i, _ in docs]
    for (_, start, n), (_, ids) in zip(shard.documents(), docs, strict=True):
        assert n == len(ids) and (n == 0 or shard.tokens(start, n).tolist() == ids.tolist())
    for i in (23, 0, 11, 5):  # in any order
        ids, mask = shard.sequence(i)
        part = flat[16 * i : 16 * i + 16]
        assert ids[mask].tolist() == part.tolist() and mask.sum() == len(part)
    assert not shard.sequence(0)[0].flags.owndata
    assert not [f for f in tmp_path.iterdir() if f.name.endswith(".tmp")]


def test_arrow_odd_rows(spark, odd, empty, tmp_path):
    shards = A.write_sequences(odd, f"file://{tmp_path}/a")
    got = A.read_documents(spark, f"file://{tmp_path}/a", shards).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want = [(r.doc_id, len(i) + 1, crc([*i, 2])) for r, i in zip(rows, library_ids([r.text for r in rows]), strict=True)]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in sorted(got, key=lambda r: r.start)] == want
    shards = A.write_sequences(empty, f"file://{tmp_path}/b")
    assert A.read_documents(spark, f"file://{tmp_path}/b", shards).count() == 0


def pieces_of(docs, capacity=2048):
    out = []
    for (i, _), ids in zip(docs, library_ids([t for _, t in docs]), strict=True):
        ids, start = [*ids, 0], 0
        head = len(ids) % capacity
        for k, part in enumerate(([ids[:head]] if head else []) + [ids[a : a + capacity] for a in range(head, len(ids), capacity)]):
            out.append((i, k, start, len(part), crc(part)))
            start += len(part)
    return out


def check_places(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark, data, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    got = P.op10_pack(spark, data).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces_of(docs))
    used, least = check_places(got), -(-sum(r.length for r in got) // 2048)
    assert used <= least + max(1, 0.01 * least)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_piece(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randrange(1, 101), r.randrange(30, 60), 50, 34]) for _ in range(400)]
    plan = P.best_two_fit(Counter(lengths), 100)
    used = Counter()
    for p in plan:
        assert sum(x * n for x, n in p.lengths) <= 100 and p.times > 0
        for x, n in p.lengths:
            used[x] += n * p.times
    assert used == Counter(lengths)
    rooms = []
    for x in sorted(lengths, reverse=True):  # best-fit decreasing, one piece at a time
        fits = [i for i, room in enumerate(rooms) if room >= x]
        at = min(fits, key=lambda i: rooms[i]) if fits else len(rooms)
        rooms[at:at + 1] = [(rooms[at] if fits else 100) - x]
    assert sum(p.times for p in plan) <= 1.03 * len(rooms) + 1
    assert P.best_two_fit({}, 100) == []


def test_two_fit_beats_one():
    """Greedy takes 60 + 33 and leaves 7; 33 gives way to 25 + 15, which fill the bin."""
    plan = P.best_two_fit({60: 1, 33: 1, 25: 1, 15: 1}, 100)
    assert dict(plan[0].lengths) == {60: 1, 25: 1, 15: 1}


def test_tighter_pair_matches_all_pairs():
    r = random.Random(9)
    for _ in range(300):
        stock = np.zeros(41, dtype=np.int64)
        for _ in range(r.randrange(0, 9)):
            stock[r.randrange(1, 41)] += r.randrange(1, 3)
        room, least = r.randrange(1, 41), r.randrange(0, 20)
        pairs = [a + b for a in range(1, 41) for b in range(1, a + 1) if a + b <= room and stock[a] and stock[b] and (a != b or stock[a] > 1)]
        got = P.tighter_pair(stock, room, least)
        assert (sum(got) if got else None) == (max(pairs) if pairs and max(pairs) > least else None)


def test_packing_odd_rows(spark, odd, empty):
    got = P.pack(odd, with_ids=True)
    rows = got.collect()
    assert sorted(tuple(r)[:5] for r in rows if r.doc_id) == sorted(pieces_of([(r.doc_id, r.text) for r in odd.collect() if r.doc_id]))
    check_places(rows)
    joined = {r.sequence_id: bytes(r.ids) for r in P.sequences(got).collect()}
    for r in rows:
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert P.pack(empty).count() == 0


def test_other_tokenizers_go_through_the_library_whole(tmp_path):
    from tokenizers import Tokenizer, normalizers

    t = Tokenizer.from_file(vocabulary_path())
    t.normalizer = normalizers.Lowercase()
    t.save(str(tmp_path / "lower.json"))
    e = WordEncoder(str(tmp_path / "lower.json"))
    assert not e.plain and e.encode("Hello There").tolist() == library_ids(["hello there"])[0]


def test_a_failed_shard_leaves_no_file(tmp_path):
    w = A.ShardWriter(f"file://{tmp_path}", "s", A.id_type(50_257), length=16, batch=2)
    w.add(1, np.arange(40, dtype=np.uint32).tobytes())
    w.discard()
    assert not list(tmp_path.iterdir())


def test_full_length_pieces_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 3)
    docs = [(i, "word " * 40) for i in range(20)]
    got = P.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=8).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces_of(docs, 8))
    check_places(got, 8)
