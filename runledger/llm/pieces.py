"""The vocabulary of a SentencePiece model file, and texts as chunks that its pieces never cross.

The tokenizer sees a text with one space put before it and every space as U+2581. Pieces hold that
mark only in front (or are runs of it), and none holds a line break or tab. So every lattice of
pieces falls apart before each run of marks and around each such character; the best or a sampled
segmentation of the text is that of its chunks, and equal chunks need to be looked at once.
"""

from __future__ import annotations

import functools
import os
import re

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
PLACEHOLDER = -1e8


class Vocabulary:
    """Pieces of a model file with id and score, and the ids of the 256 byte pieces.

    A character that no piece covers is written as the pieces of its UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        # Pieces that merging never scores carry -1e9; here they come after all others, by one.
        floor = min(x for x in self.scores.values() if x > PLACEHOLDER) - 1
        self.scores = {p: x if x > PLACEHOLDER else floor for p, x in self.scores.items()}
        self.longest = max(map(len, self.ids))
        #: What an uncovered character costs: 10 below the least score, as the tokenizer has it.
        self.uncovered = min(self.scores.values()) - 10
        alone = "".join(c for c in "\t\n\x0b\x0c\r" if not any(c in p for p in self.ids))
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"Pieces cross word boundaries: {crossing[:3]}")
        self.chunk = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))

    def chunks(self, marked: str) -> list[str]:
        """The chunks of a text whose spaces are marks; joined they are the text."""
        return self.chunk.findall(marked)


def marked(text: str) -> str:
    """The text as the tokenizer sees it; the empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
