"""Column functions: text preparers, tokenisers and encoders."""

from linkwright.functions.dates import approximate_date, date_tokens, normalize_date
from linkwright.functions.phonetic import as_cologne, as_metaphone, as_soundex
from linkwright.functions.step import Step, custom_step, run_steps
from linkwright.functions.street import normalize_street
from linkwright.functions.text import normalize_text, strip_vowels, use_dictionary
from linkwright.functions.tokens import (
    drop_numeric_tokens,
    drop_short_tokens,
    extract_initials,
    filter_stopwords,
    generate_ngrams,
    numeric_tokens,
    token_shapes,
    word_tokens,
)

__all__ = [
    "Step", "approximate_date", "as_cologne", "as_metaphone", "as_soundex", "custom_step", "date_tokens", "drop_numeric_tokens",
    "drop_short_tokens", "extract_initials", "filter_stopwords", "generate_ngrams", "normalize_date", "normalize_street", "normalize_text",
    "numeric_tokens", "run_steps", "strip_vowels", "token_shapes", "use_dictionary", "word_tokens",
]
