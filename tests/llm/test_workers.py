"""What a Python worker holds, during a task and after it."""

import pyarrow as pa
import pytest

from repolume.llm import common, hashing, packing


def texts(rows):
    return pa.RecordBatch.from_pydict({"id": list(range(len(rows))), "text": rows})


def test_pieces_are_bounded_and_whole():
    batch = texts(["x" * 3000] * 5000)
    pieces = list(common.in_pieces(iter([batch, texts([]), texts(["y" * 5_000_000, "z"])])))
    assert max(p.nbytes for p in pieces[:-2]) <= common.PIECE_BYTES
    assert pa.Table.from_batches([p for p in pieces if p.num_rows > 2]).num_rows == 5000
    assert [p.column(1).to_pylist()[0][0] for p in pieces[-2:]] == ["y", "z"]
    assert [i for p in pieces for i in p.column(0).to_pylist()] == [*range(5000), 0, 1]


@pytest.mark.parametrize("whole", [True, False])
def test_an_ended_task_gives_memory_back(spark, monkeypatch, whole):
    class Mapped:
        sparkSession = spark

        def mapInArrow(self, function, schema):
            return function

    back = []
    monkeypatch.setattr(common, "give_back", lambda: back.append(1))
    rows = common.map_arrow(Mapped(), lambda batches: batches, "id long")(iter([1, 2]))
    assert next(rows) == 1 and not back
    if whole:
        assert list(rows) == [2]
    else:
        rows.close()
    assert back == [1]


def test_memory_can_be_given_back():
    common.give_back()


def test_word_hashes_keep_few_and_short_words():
    hashes = hashing.WordHashes()
    long = b"x" * 1_000_000
    for at in range(0, 400_000, 50_000):
        words = [b"%d" % i for i in range(at, at + 50_000)]
        got = hashes.of(b" ".join([*words, long]))
        assert len(hashes) <= 150_000 + 1 and long not in hashes
        assert got[0] == hashing.WordHashes().of(words[0])[0] and got[-1] == hashes.of(long)[0]


def test_words_are_encoded_in_bounded_parts(monkeypatch):
    tokens = packing.WordTokens(packing.public_tokenizers.path(packing.VOCABULARY))
    sizes, ids = [], tokens._ids

    def counted(parts):
        sizes.append(sum(len(p.split()) for p in parts))
        return ids(parts)

    monkeypatch.setattr(tokens, "_ids", counted)
    letters = "abcdefghijklmnopqrst"
    runs = ["".join(letters[(i // 20**k) % 20] for k in range(4)) for i in range(25_000)]
    others = [f"{i}x" for i in range(12_000)]
    text = " ".join(runs + others)
    (got,) = tokens.encode([text.encode()])
    assert max(sizes) <= 10_000 and sum(sizes) >= 37_000
    assert got == ids([text])[0].tobytes()
