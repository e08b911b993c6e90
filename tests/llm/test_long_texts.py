import signal

import numpy as np
import pytest

from factloom.llm import bpe
from factloom.llm.arrow import mixed
from factloom.llm.pretoken import Codes
from factloom.llm.queries import tokenizer


@pytest.fixture(autouse=True)
def limited():
    """A full table would be searched for ever."""
    def stop(*_):
        raise TimeoutError

    held = signal.signal(signal.SIGALRM, stop)
    signal.alarm(20)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, held)


def test_codes_grow():
    codes, keys = Codes(bits=4), mixed(np.arange(1, 5001, dtype=np.uint64)) | np.uint64(1)
    keys = np.unique(keys)
    for some in np.array_split(np.arange(len(keys)), 7):
        codes.add(keys[some], some)
        assert codes.used * 2 <= len(codes.keys)
    assert codes.used == len(keys) and (codes.find(keys) == np.arange(len(keys))).all()
    assert (codes.find(keys + np.uint64(1)) == -1).all()


def test_one_text_of_more_words_than_slots(monkeypatch):
    text = " ".join(f"{i}x{i * 7}" for i in range(3000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    path = tokenizer("byte_bpe_50k.json")
    want, _ = bpe.ByteBPE(path).encode(data, offsets)
    small = bpe.ByteBPE(path)
    small.codes = Codes(bits=4)
    got, ends = small.encode(data, offsets)
    assert got.tolist() == want.tolist() and ends.tolist() == [0, len(got)]
    assert small.decode(got, ends) == [text.decode()]
