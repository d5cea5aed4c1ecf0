"""The encoder of the token files: ids equal to the library's, few calls, bounded memory."""

import cProfile
import pstats
import random
import tracemalloc

import pyarrow as pa
import pytest

from ledgerline.llm import token_files
from ledgerline.llm.queries import tokenizer_path

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def invented(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=rng.randint(4, 12))) for _ in range(n)]


def texts_of(words, per=500):
    return [" ".join(words[i : i + per]) for i in range(0, len(words), per)]


@pytest.mark.parametrize("cache_bytes", [0, 2000, token_files.CACHE_BYTES])
def test_ids_of_all_kinds_of_words(cache_bytes):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    e = token_files.Encoder(tokenizer_path(), cache_bytes)
    rng = random.Random(5)
    words = [*invented(40, 1), "Größe", "été,", "naïve.", "слово", "слово,", "中文。", "x×y", "÷", "don't", "it's.", "'s", "a.b", "a,.", "..", "3,5", "12.", "<|endoftext|>", "a<|endoftext|>,", "Ġ", "Ċ", "Ġa.", "a\tb", "­", "\x01,", "é."]
    for _ in range(6):
        texts = [rng.choice(["", "", " ", "\n", "\t", "　"]) + "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", " "]) for _ in range(rng.randint(0, 30))) + rng.choice(["", *words, "\n", "\t"]) for _ in range(200)]
        ids, n = e.encode(pa.array([*texts, None, ""]))
        want = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in [*texts, "", ""]]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]


def test_new_words_take_few_calls():
    words = invented(20_000, 2)
    e, p = token_files.Encoder(tokenizer_path()), cProfile.Profile()
    p.runcall(e.encode, pa.array(texts_of([w + "," if i % 9 == 0 else w for i, w in enumerate(words)])))
    assert pstats.Stats(p).total_calls < len(words) / 10


def test_words_kept_take_bounded_memory():
    e = token_files.Encoder(tokenizer_path())
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
        for seed in range(12):
            e.encode(pa.array(texts_of(invented(50_000, seed))))
            assert tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before < 24 << 20
    finally:
        tracemalloc.stop()
