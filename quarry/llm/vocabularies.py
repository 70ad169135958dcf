"""Places of the public vocabulary files that the registered queries use (parameters of the operators)."""

import public_tokenizers

PATTERN = public_tokenizers.PATTERN
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
