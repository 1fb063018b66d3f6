"""Column -> Column building blocks (all native Spark expressions)."""

from .keywords import (contains_any, detect_platform, detect_severity,  # noqa: F401
                       has_any, keywords_found, label_post)
from .numeric import (argmax, label_to_polarity, make_int,  # noqa: F401
                      polarity_to_label, sentiment_boost, softmax,
                      token_windows, cluster_count)
from .text import (bullets, clean_markup, epoch_to_iso, full_text,  # noqa: F401
                   head_chars, mask_handles_urls, normalize_title,
                   sentence_pieces, strip, tokenize, underline)
