"""The encoder's ids equal the tokenizer's, also while its stores of words turn over."""

from __future__ import annotations

import random
import struct

from orthospark.llm import tokens
from orthospark.llm.packing import TOKENIZER


def test_ids_while_stores_turn_over(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "KEPT_WORDS", 200)
    path, draw = tokens.tokenizer_path(TOKENIZER), random.Random(1)
    encoder, tokenizer, turned = tokens.WordEncoder(path), Tokenizer.from_file(path), 0
    words = ["".join(draw.choice("abcdeéß中A.,'1") for _ in range(draw.randint(1, 5))) for _ in range(800)]
    for _ in range(200):
        texts = [" ".join(draw.choices(words[: draw.randint(1, 800)], k=draw.randint(0, 60))) for _ in range(5)]
        before = encoder.known
        found = encoder.encode(texts)
        turned += encoder.known is not before
        for x, ids in zip(texts, found):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tokenizer.encode(x, add_special_tokens=False).ids
    assert turned > 1


def test_ids_of_any_letters():
    """100,000 texts of letters that change their length in lower case, marks, scripts without spaces, signs and odd white space."""
    encoder, draw = tokens.WordEncoder.of(tokens.tokenizer_path(TOKENIZER)), random.Random(2)
    letters = [*"abcXYZ\u0130\u0131\u015e\u0141\u1e9e\u017f\u00df\u01c5\u00e9\u0301\u0307\u200d\ufe0f\u6f22\U00020061\U0001f600\u2600\ufb01\u2126\u212a\u00aa\u0345\u1fb3\u03a3\u03c2\u093e\u0915\ufdfa\uac00"]
    signs, spaces = [*".,.,.,;:!?'\"-_/\\()[]<>|#0123456789\u2026\u2014\u2019\u00ab"], [*"     \n\t\u00a0\u3000\x1c\x85\u2028\x00"]

    def word():
        return "".join(draw.choices(letters, k=draw.randint(1, 5))) + draw.choice(["", *signs])

    for _ in range(50):
        texts = ["".join(word() + draw.choice(spaces) for _ in range(draw.randint(0, 4))) for _ in range(2000)]
        for x, ids in zip(texts, encoder.encode(texts)):
            assert ids == encoder.encoded(x), x
    for x in ("B\u00dcY\u00dcK \u015eEHR\u0130.", "\u015eEHR\u0130, K\u00d6Y", "\u0130,"):
        assert encoder.encode([x])[0] == encoder.encoded(x)
