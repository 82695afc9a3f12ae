"""What the token operators need from a SentencePiece model file."""

import re
from functools import lru_cache

import sentencepiece

BLANK = "▁"
#: A run of blanks and the word after it.
SEGMENT = re.compile(" +[^ ]*")
#: Bytes of words and their results that a task keeps; then it starts anew.  Longer words are not kept.
KEPT_BYTES = 48_000_000
KEPT_LENGTH = 256


def default_model():
    """Bytes of the public model file that the queries use."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


class Pieces:
    """The ordinary pieces of a model, its byte pieces and its scores.

    No piece may hold a blank after another character, so that a text is the
    sequence of its segments (blanks, then a word) and pieces never cross
    from one to the next.
    """

    def __init__(self, model):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        p = self.processor
        special = [i for i in range(p.get_piece_size()) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)]
        self.texts = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.ids = {self.texts[i]: i for i in set(range(len(self.texts))) - set(special)}
        self.bytes = {int(self.texts[i][1:-1], 16): i for i in special if p.is_byte(i)}
        self.scores = [p.get_score(i) for i in range(len(self.texts))]
        self.longest = max(map(len, self.ids))
        self.alphabet = set("".join(self.ids))
        if any(BLANK in t.lstrip(BLANK) for t in self.ids):
            raise ValueError("the model has pieces with a blank after another character")
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte pieces")


class Kept(dict):
    """Results by word, bounded by the bytes that they take; starting anew changes no result.

    ``a_character`` are the bytes that a character's result takes.  ``missing`` makes room
    for the words that are not there; those too long to keep are its second answer.
    """

    def __init__(self, a_character):
        super().__init__()
        self.a_character, self.size = a_character, 0

    def missing(self, words):
        new = {w for w in set(words) if w not in self}
        long = {w for w in new if len(w) > KEPT_LENGTH}
        size = self.cost(new - long)
        if self.size + size > KEPT_BYTES:
            self.clear()
            new = set(words)
            size = self.cost(new - long)
            self.size = 0
        self.size += size
        return new - long, long

    def cost(self, words):
        return 250 * len(words) + (4 + self.a_character) * sum(map(len, words))


@lru_cache(maxsize=2)
def pieces(model):
    return Pieces(model)


def segments(text):
    """The segments of a text as the model sees it, with the blank put before its start."""
    return SEGMENT.findall(" " + text) if text else []
