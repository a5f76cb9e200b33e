"""Column -> Column functions, all of them JVM expressions."""
from petrel.functions.text import (  # noqa: F401
    clean_text, corpus_text, keep_chars, lower, norm_quotes, squeeze_space,
    strip_literal_newline, strip_punct, symbols_to_space,
)
from petrel.functions.arrays import (  # noqa: F401
    add_special, argmax, attention_mask, content_len, detokenize, drop_listed,
    join_ints, min_len, one_hot, pad_post, pad_pre, segments, softmax,
    special_mask, special_mask_done, token_types, tokenize,
)
from petrel.functions.accents import strip_accents  # noqa: F401
