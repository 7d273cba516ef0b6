import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kithgraph.llm import token_ids


@pytest.fixture(scope="module")
def library():
    whole = Tokenizer.from_file(token_ids.vocabulary())
    whole.encode_special_tokens = True
    return whole


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["\n", "\n\n", "\n\n\n", " ", "\t", "\r\n", " ", " ", "\x1c", "a", "Été", "don't", "x.", "9", "***", "日", "!!,", "ǅ×"]), max_size=9).map("".join))
def test_white_space_around_line_feeds_is_cut_as_the_library_cuts_it(library, text):
    assert token_ids.encoder(token_ids.vocabulary())(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_end_at_line_feeds(monkeypatch, library):
    """A word is kept once, whatever the line before it ended with."""
    monkeypatch.setattr(token_ids, "_LIBRARIES", {})
    encode = token_ids.encoder(token_ids.vocabulary())
    text = "\n".join(f"one {a} two" for a in ("x", "yy", "zzz.", "été***")) + "\n\nlast\n"
    assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    kept = token_ids._LIBRARIES[token_ids.vocabulary()]
    assert not [c for c in (*kept.spaced, *kept.plain) if "\n" in c[1:]]
