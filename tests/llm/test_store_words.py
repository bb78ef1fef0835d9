"""The store's words, cut by Arrow, against the library's whole texts."""

import numpy as np
import pyarrow as pa

from weekcast.llm import token_store


def test_store_words_are_cut_by_arrow():
    """Arrow columns, slices of them and lists give the same ids; nulls have none."""
    words = token_store.encoder(token_store.tokenizer_path())
    texts = [None, "", " ", "\n", "a\n\nb  c ", "ÉCOLE élan\tx\r\nz", "word. ###", " lead", "x" * 70 + " " + "y" * 70, None]
    column = pa.array(texts, pa.string())
    want = [np.array(words.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert words.encode_many(column) == want
    assert words.encode_many(column.slice(4, 3)) == want[4:7]
    assert words.encode_many(column.slice(0, 1)) == [b""] and words.encode_many(column.slice(2, 0)) == []
    assert words.encode_many([t or "" for t in texts]) == want
