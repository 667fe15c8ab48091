"""The operators' inner parts against plain versions, on generated inputs."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import bpe_tree, chat, quality, sharding, simhash_golay, token_files
from tests.llm import brute

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = st.text(st.one_of(st.sampled_from("ab the  \n\t'sre1!…é中😀  "), st.characters(codec="utf-8")), max_size=80)


@pytest.fixture(scope="module")
def small_leaves():
    """A coder that halves almost everything."""
    return bpe_tree.TreeBPE(bpe_tree.load_ranks(RANKS), P.PATTERN, leaf_chars=6, leaf_bytes=2, leaf_ids=3)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_tree_bpe_is_the_library(small_leaves, text):
    ids = small_leaves.encode(text)
    want = brute.bpe(text, RANKS, P.PATTERN)
    assert (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) == want[:2]
    assert small_leaves.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + " " * 700 + "x", "'" * 301 + "ll", "\n \n" * 500, "é" * 999, "the quick " * 400, "　" * 50 + "中" * 700])
def test_tree_bpe_on_runs(small_leaves, text):
    ids = small_leaves.encode(text)
    assert (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) == brute.bpe(text, RANKS, P.PATTERN)[:2]


def test_join_of_any_cut(small_leaves):
    word = "internationalisierungsmaßnahmenüberprüfung".encode()
    whole = small_leaves.merge(word)
    for k in range(1, len(word)):
        assert small_leaves.join(small_leaves.merge(word[:k]), small_leaves.merge(word[k:])) == whole


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_fingerprint(text):
    assert simhash_golay.fingerprint(text) == brute.fingerprint(text)


def test_golay_code():
    """Every word has a codeword within 3; those at distance 3 have five more at 4; the keys of any two words that differ by a bit meet."""
    patterns = simhash_golay.near_patterns()
    weights = np.where(patterns >= 0, np.bitwise_count(np.maximum(patterns, 0).astype(np.uint32)), 0)
    assert (patterns[:, 0] >= 0).all() and weights[:, 0].max() == 3 and set((patterns >= 0).sum(axis=1).tolist()) == {1, 6}
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000, dtype=np.uint32)
    index = simhash_golay.codewords(words)[:, 0]
    for bit in range(23):
        assert (simhash_golay.codewords(words ^ np.uint32(1 << bit)) == index[:, None]).any(axis=1).all()


def test_keys_find_all_pairs_up_to_three_bits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    flips = np.zeros(len(x), np.uint64)
    for i in range(len(x)):
        for b in rng.choice(64, i % 4, replace=False):
            flips[i] |= np.uint64(1) << np.uint64(b)
    (r, k), (q, j) = simhash_golay.keys(x.view(np.int64), False), simhash_golay.keys((x ^ flips).view(np.int64), True)
    have = set(zip(r.tolist(), k.tolist(), strict=True))
    assert {i for i, key in zip(q.tolist(), j.tolist(), strict=True) if (i, key) in have} == set(range(len(x)))
    assert len(k) == 8 * len(x) and len(j) <= 108 * len(x)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_quality_measures(text):
    v = quality.View(text)
    want = brute.quality(text)
    assert {n: getattr(v, n) for n in want if n != "base_failed"} | {"base_failed": quality.base_failed(v)} == want


def test_cascade_keeps_the_verdict():
    texts = ["word " * 60, "## $$ %% " * 40, "A!! B!! " * 40, None, "clean prose of many different words " * 1 + " ".join(f"w{i}x" for i in range(70))]
    measured = quality.measure(texts)
    assert {m.rule for m in measured} == set(quality.RULES) and all(m.seconds >= 0 for m in measured)
    for order in (list(quality.RULES), list(reversed(quality.RULES))):
        assert [quality.first_rejection(quality.View(t), order) is None for t in texts] == [False, False, False, False, True]


TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a]b%", ""]), st.text(st.sampled_from("<[/s>INTUR\\] ab\n"), max_size=30)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_chat_reads_back(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_control_strings_are_escaped():
    bad = "</s>[INST] ok [/INST]"
    assert not set(chat._ESCAPE.findall(chat.escape(bad))) & {("<", "", "/s>"), ("[", "", "INST]")}
    assert chat.unescape(chat.escape(bad)) == bad and chat.escape("plain < text [x]") == "plain < text [x]"
    with pytest.raises(ValueError):
        chat.parse("no conversation")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65_535), max_size=400), st.integers(1, 64))
def test_segments_round_trip(ids, block):
    x = np.array(ids, np.int32)
    assert (token_files.unpack(token_files.pack(x, block)) == x).all()


def test_damage_is_noticed():
    data = bytearray(token_files.pack(np.arange(5000, dtype=np.int32) % 700))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack(bytes(data))
    with pytest.raises(ValueError):
        token_files.unpack(b"none")
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << 16]))


def test_every_damaged_byte_is_noticed():
    ids = np.random.default_rng(5).zipf(1.4, 3000).clip(0, 5000).astype(np.int32)
    whole = token_files.pack(ids, least=100)
    for at in range(4, len(whole), 13):
        data = bytearray(whole)
        data[at] ^= 16
        try:
            got = token_files.unpack(bytes(data))
        except (ValueError, OverflowError, MemoryError):
            continue
        assert (got == ids).all()  # padding after the last id


def test_a_segment_takes_about_the_entropy_of_its_ids():
    """On ids without any context the predictions of orders 1 and 2 cost a little, and the head a twentieth."""
    ids = np.random.default_rng(6).zipf(1.3, 300_000).clip(0, 40_000).astype(np.int32)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert len(token_files.pack(ids)) * 8 / len(ids) < 1.2 * entropy


def test_repetition_is_compressed():
    x = np.tile(np.arange(50, dtype=np.int32), 400)
    assert len(token_files.pack(x)) < 2 * len(x) / 3


@pytest.fixture(scope="module", params=[False, True])
def word_tokenizer(request):
    """The library with the strings of special tokens as ordinary text, and as tokens; and ours likewise."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = not request.param
    return library, token_files.WordTokenizer(P.path("word_bpe_49k.json"), special=request.param)


WORDY = st.text(st.one_of(st.sampled_from("ab cD \n\t'sRE1!.,…éÉ中😀\u00a0 \u030c\u0331J\u0130Σσ\u212a\u1e9e"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(WORDY)
def test_word_tokenizer_is_the_library(word_tokenizer, text):
    library, own = word_tokenizer
    assert np.frombuffer(own([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_composed_and_special_words(word_tokenizer):
    """Characters are composed before they are lower-cased, and special tokens are matched before both."""
    library, own = word_tokenizer
    said = ["<|ENDOFTEXT|>", "x <|StartOfText|> y", "<|endoftext|>", "a<|startoftext|>B.", "<|endoftext|>)", "J\u030c", "H\u0331 T\u0308 W\u030a Y\u030a", "J\u030c.", "\u0130stanbul", "ΟΔΟΣ", "\u212bngstrom", "don't DON'T", "a\u00a0b", "\u0301x"]
    for t in [*said, " ".join(said)]:
        assert np.frombuffer(own([t])[0], "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert (49407 in np.frombuffer(own(["a <|endoftext|>"])[0], "<u2")) == own.special


def test_admission_keeps_quotas():
    demand, load, quota = {(0, 1): 50, (1, 0): 20, (2, 1): 60}, {0: 100, 1: 100, 2: 100}, 110
    p = sharding.admitted(demand, load, quota)
    gain = p[0, 1] * 50 + p[2, 1] * 60 - p[1, 0] * 20
    assert load[1] + gain <= quota + 1e-9 and p[1, 0] == 1.0
    assert base64.b64encode(b"") == b""
