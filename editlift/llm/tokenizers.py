"""Where the public vocabulary lies; every executor has the package."""

import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
