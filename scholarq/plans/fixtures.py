"""Small self-written inputs for the test-data queries.

The lexicon mixes ordinary sentiment words with frequent tokens of the
synthetic ``documents`` prose (so that scores are not all zero there);
it is a test fixture, not a general-purpose lexicon.
"""

from scholarq.operators.sentiment import Lexicon

# Test lexicon (token -> valence on the -4..4 scale).
TEST_VALENCES = {
    "good": 1.9, "great": 3.1, "best": 3.2, "excellent": 2.7, "love": 3.2, "happy": 2.7, "nice": 1.8,
    "bad": -2.5, "worst": -3.1, "poor": -2.1, "terrible": -2.5, "hate": -2.7, "sad": -2.1, "awful": -2.0,
    "bien": 1.6, "bon": 1.5, "mal": -1.8, "gut": 1.7, "schlecht": -2.0, "bueno": 1.8, "malo": -2.0,
    "th": 1.2, "er": -0.9, "nd": 0.7, "ha": -1.4, "ing": 0.6, "tion": -0.5,
    "eau": 1.1, "ai": -0.8, "ç": 0.4, "sch": -0.7, "ch": 0.5, "te": -0.6,
    "ción": 0.9, "ar": -1.1, "os": 0.3, "do": -0.4, "è": 0.8, "é": -0.3,
}
# Negators and boosters of the test lexicon.
TEST_NEGATORS = ("not", "no", "never", "nicht", "kein", "pas", "jamais", "nunca", "nie")
TEST_BOOSTERS = ("very", "really", "extremely", "sehr", "très", "muy", "the", "de", "der", "la")

# Dampeners of the test lexicon.
TEST_DAMPENERS = ("slightly", "somewhat", "kaum", "peu", "poco", "of", "le", "und", "que")

TEST_LEXICON = Lexicon(TEST_VALENCES, TEST_NEGATORS, TEST_BOOSTERS, TEST_DAMPENERS)
