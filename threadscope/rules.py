"""Default dictionaries and word lists.

Operators take these as parameters; nothing downstream hard-codes them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES -- must equal the behaviour being reproduced.  Stated plainly,
# in their natural order.  Matching is by lower-case substring.
# ---------------------------------------------------------------------------

# Bug keywords, list order.  "fix" is listed twice on purpose: the list of
# keywords found reports it twice.
BUG_KEYWORDS = [
    "bug", "glitch", "issue", "broken", "crash", "error", "problem",
    "not working", "buggy", "fix", "patch", "freeze", "stuck", "lag",
    "fps drop", "graphics issue", "performance issue", "low graphics",
    "low fps", "low performance", "low frame rate", "fix",
]

# Platform -> keywords, in dictionary order.
PLATFORM_KEYWORDS = {
    "pc": ["pc", "steam", "epic", "desktop", "computer", "windows", "fps"],
    "playstation": ["ps4", "ps5", "playstation", "psn"],
    "xbox": ["xbox", "series x", "series s", "xsx", "xss"],
    "switch": ["switch", "nintendo"],
}

# Severity -> keywords; the first level that matches wins.
SEVERITY_KEYWORDS = {
    "critical": ["crash", "unplayable", "broken", "game breaking", "save corrupted"],
    "high": ["freeze", "stuck", "cant progress", "can't progress"],
    "medium": ["graphics", "audio", "visual", "ui"],
    "low": ["minor", "cosmetic", "typo", "text"],
}

# Post categories, tested in this order after the bug keywords.
FEATURE_KEYWORDS = ["feature", "suggestion", "request"]
QUESTION_KEYWORDS = ["help", "question", "how", "what"]
CATEGORY_BUG = "Bug"
CATEGORY_FEATURE = "Feature Request"
CATEGORY_QUESTION = "Question"
CATEGORY_OTHER = "Other"
CATEGORY_EMPTY = "Uncategorized"

RESOLVED_KEYWORDS = ["resolved", "fixed", "solved"]
SOLUTION_KEYWORDS = ["solution", "fix", "solved", "resolved"]

UNSPECIFIED = "unspecified"
DELETED_AUTHOR = "[deleted]"
DEAD_MARKERS = ["[deleted]", "[removed]"]

# Severity levels that get a mean polarity (unspecified excluded).
SEVERITY_LEVELS = ["critical", "high", "medium", "low"]

# Sentence score boosts by comment sentiment label.
BOOST_POSITIVE = 1.1
BOOST_NEGATIVE = 1.3

# Summary fallbacks.
MSG_NO_COMMENTS = "No valid text found for summarization"
MSG_BLANK_TEXT = "No valid text for summarization"
MSG_NOT_SCORED = "No sentences scored for summarization"

DISCUSSION_TITLE_PREFIX = "Discussion "
NO_FORUM = "No subreddit found"
MAX_CLUSTERS = 5

# Extra stop words on top of the English list.
EXTRA_STOP_WORDS = ["game", "update", "patch", "play"]

# The common public English stop-word list (179 words).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "s", "t", "can", "will", "just",
    "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re",
    "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven",
    "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't",
    "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]


def default_stop_words() -> list[str]:
    return ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS


# ---------------------------------------------------------------------------
# Parameters of our own (not reference values): a small default sentiment
# lexicon (word, polarity, subjectivity).  Callers pass their own table.
# ---------------------------------------------------------------------------
DEFAULT_LEXICON = [
    ("good", 0.7, 0.6), ("great", 0.8, 0.75), ("best", 1.0, 0.3),
    ("better", 0.5, 0.5), ("love", 0.5, 0.6), ("excellent", 1.0, 1.0),
    ("amazing", 0.6, 0.9), ("awesome", 1.0, 1.0), ("nice", 0.6, 1.0),
    ("happy", 0.8, 1.0), ("perfect", 1.0, 1.0), ("wonderful", 1.0, 1.0),
    ("fantastic", 0.4, 0.9), ("beautiful", 0.85, 1.0), ("fun", 0.3, 0.2),
    ("enjoy", 0.4, 0.5), ("thanks", 0.2, 0.2), ("helpful", 0.5, 0.5),
    ("bad", -0.7, 0.667), ("worse", -0.4, 0.6), ("worst", -1.0, 1.0),
    ("terrible", -1.0, 1.0), ("awful", -1.0, 1.0), ("horrible", -1.0, 1.0),
    ("hate", -0.8, 0.9), ("boring", -1.0, 1.0), ("annoying", -0.8, 0.9),
    ("useless", -0.5, 0.2), ("broken", -0.4, 0.4), ("poor", -0.4, 0.6),
    ("sad", -0.5, 1.0), ("ugly", -0.7, 1.0), ("dumb", -0.375, 0.5),
    ("stupid", -0.8, 1.0), ("idiot", -0.8, 1.0), ("moron", -0.8, 1.0),
    ("clown", -0.3, 0.6), ("loser", -0.6, 0.8), ("trash", -0.6, 0.8),
    ("garbage", -0.6, 0.8), ("scum", -0.9, 0.9), ("pathetic", -1.0, 1.0),
    ("disgusting", -1.0, 1.0), ("worthless", -0.8, 0.9),
]
