"""What the quality rules count, against regular expressions over each text."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex

from siftline.llm import quality
from siftline.llm import textops as tx


def brute(text):
    words = [w for w in regex.split(r"[ \t\n\x0b\f\r]+", text) if w]
    low = ["".join(c.lower() if len(c.lower()) == 1 and regex.match(r"\p{L}", c) else c for c in w) for w in words]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    n = lambda pattern: len(regex.findall(pattern, text))
    return {
        "chars": len(text), "words": len(words), "kinds": len(set(low)), "stops": sum(w.rstrip(".,") in quality.STOP for w in low), "lines": len(lines), "line_kinds": len(set(lines)),
        "closed": sum(bool(regex.search('[.!?:;"”…][ \t]*$', x)) for x in lines), "symbols": n(r"[#$%&*|@^~<>=+\\{}\[\]_]+"), "bangs": n("!+"), "letters": n(r"\p{L}"), "upper": n(r"\p{Lu}"),
        "alpha_words": sum(bool(regex.fullmatch(r"[\p{L}'’\-]+[.,;:!?]?", w)) for w in words),
    }


ODD = ["", " ", "\n\n", "The, the. THE.., a!!! b", "don't well-known x’y ok? no?! -", "…\n.\t \nline one.\nline one.\n  \nÀ la çã é”", "a" * 3000, "#$%_ [x] {y} <b>", "中文 字\U0001f600 Ñandú", "\t.\n!", "é İstanbul ẞ", "x\r\ny.", "end .,.,", ".,"]


def test_counts_match_regular_expressions():
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:150] + ODD
    data, off = tx.string_buffers(pa.array(texts), False)
    found = quality.features(data, off)
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in found.items()} == brute(text), text[:80]
    none = quality.features(np.zeros(0, dtype=np.uint8), np.zeros(3, dtype=np.int64))
    assert all(v.tolist() == [0, 0] for v in none.values())
