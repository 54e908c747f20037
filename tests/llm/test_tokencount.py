import random

from samewise.llm import tokencount as T
from samewise.llm.tokens import library, vocabulary

PATH = vocabulary("word_bpe_49k.json")


def true_ids(t):
    return library(PATH).encode(t or "", add_special_tokens=False).ids


def odd_texts(n=300):
    rng = random.Random(1)
    some = ["abc", "Don't", "É", "é", "́", "ﬁ", "日本", "🙂", "<|endoftext|>", "<|startoftext|>", "12²", "...", "\x1c", "\u0085", " ", " ", " ", "\n", "\t ", "x" * 30, "ß", "İ"]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_counts_equal_the_library():
    texts = odd_texts()
    assert T.Counter(PATH)(texts) == [len(true_ids(t)) for t in texts]


def test_spliced_ids_equal_the_whole_encoding():
    rng = random.Random(2)
    for t in (" ".join(odd_texts(60)), "word " * 3000, "x" * 5000, "a" * 3000 + " b c " + "é" * 3000, "".join(rng.choice("ab c") for _ in range(9000)), ""):
        for chunk, lap in ((200, 10), (64, 4), (1000, 200)):
            got = [x[0] for part in T.encode_huge(PATH, t, chunk, lap) for x in part]
            assert got == true_ids(t), (t[:40], chunk)


def test_rows(spark):
    rows = [(1, "hello world", 1), (2, None, 1), (3, "", 1), (None, "a b", 1), (1, "hello world", 1), (4, "long text " * 20_000, 2)]
    got = T.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, len((t or "").encode()), len(true_ids(t))) for i, t, _ in rows], key=str)
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
