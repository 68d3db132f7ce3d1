"""Tasks leave no tables of powers behind, and words are dealt to their documents as before."""
import numpy as np

from sparkloom.llm import common, decontam


def test_tidy():
    def run(batches):
        for b in batches:
            yield common.Rolling(np.frombuffer(b, np.uint8))(np.array([0]), np.array([2]))[0]

    one, two = common.tidy(run)([b"abab", b"ba"])
    assert one != two and common._powers.cache_info().currsize == 0


def test_words_of_documents():
    texts = [b"", b"a b", b"", b" ", b"c", b"d a a a", b""]
    lens = np.array([len(t) for t in texts])
    b = np.frombuffer(b"".join(texts), np.uint8)
    assert common.word_spans(b, lens)[2].tolist() == [1, 1, 4, 5, 5, 5, 5]
    w = decontam.Words(b, lens)
    assert w.once(w.chunks(4)[0]).tolist() == [0, 1, 2, 3, 4]
