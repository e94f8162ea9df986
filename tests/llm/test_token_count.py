import base64
import random

import pyarrow as pa

from gleaner.llm import token_count
from tests.llm.cases import docs, odd_docs, words


def greedy(text, vocabulary):
    known, n = set(vocabulary) | {bytes([b]) for b in range(256)}, 0
    longest = max(map(len, known))
    for w in text.encode().split():
        w, i = b" " + w, 0
        while i < len(w):
            i += next(k for k in range(min(longest, len(w) - i), 0, -1) if w[i : i + k] in known)
            n += 1
    return n


def test_against_greedy_longest_match():
    r = random.Random(0)
    for _ in range(150):
        vocabulary = [bytes(r.choice(b"ab ") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(12))]
        texts = ["".join(r.choice("ab \n") for _ in range(r.randrange(40))) for _ in range(8)]
        got = token_count.count_texts(pa.array(texts), token_count.Automaton(vocabulary))
        assert got.tolist() == [greedy(t, vocabulary) for t in texts]


def test_long_words_step_alone():
    vocabulary = [b"ab", b"aba", b" a", b"bb"]
    texts = ["ab" * 5000, "b" * 4097 + " ab", "é" * 3000]
    got = token_count.count_texts(pa.array(texts), token_count.Automaton(vocabulary))
    assert got.tolist() == [greedy(t, vocabulary) for t in texts]


def vocabulary_file(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(w).decode()} {i}\n" for i, w in enumerate([b" w1", b"w2", b"23", b" one"])))
    return str(path)


def test_odd_rows(spark, tmp_path):
    path = vocabulary_file(tmp_path)
    got = token_count.token_counts(docs(spark), path).collect()
    by = {r.doc_id: r.n_tokens for r in got if r.doc_id}
    assert len(got) == 14 and by[3] is None and by[4] == by[5] == 0 and by[11] == 1
    assert by[8] == greedy(words(30_000, 1), token_count.read_vocabulary(path)) and by[9] == 300_001
    assert token_count.token_counts(docs(spark, []), path).count() == 0


def test_a_changed_file_is_read_again(spark, tmp_path):
    path = vocabulary_file(tmp_path)
    d = spark.createDataFrame([(1, "one one")], "doc_id long, text string")
    assert token_count.token_counts(d, path).first().n_tokens == 2
    (tmp_path / "ranks").write_text("")
    assert token_count.token_counts(d, path).first().n_tokens == 8


def test_odd_columns(spark, tmp_path):
    assert token_count.token_counts(odd_docs(spark), vocabulary_file(tmp_path)).count() == 16
