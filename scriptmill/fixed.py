"""They must be exactly these for results to be right."""

# Emotion tags that may appear in narration text.
EMOTIONS = ["laugh", "chuckle", "sigh", "cough", "sniffle", "groan", "yawn", "gasp"]
EMOTION_TAGS = [f"<{name}>" for name in EMOTIONS]
# Prompt markup that sometimes leaks into a response.
STRUCTURAL_TAGS = ["<text_segment>", "</text_segment>", "<text>", "</text>",
                   "<input>", "</input>", "<output>", "</output>"]

# Words an English number is spelled with.
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
    "hundred", "thousand", "million", "billion", "point",
]

# Abbreviations whose final dot is not the end of a sentence.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "Inc", "Ltd", "Co", "etc", "vs",
                 "vol", "no", "pp"]
# Verbs that follow a speaker's name after a quotation.
ATTRIBUTION_VERBS = ["said", "asked", "replied", "whispered", "shouted", "exclaimed", "muttered",
                     "declared", "grinned", "smiled", "nodded", "gasped", "added", "stepped",
                     "pulled", "pointed", "stopped", "noticed", "flipped", "closed"]
# A short line holding any of these (as a substring) is not a title.
FUNCTION_WORDS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
# Words that mark a section line at either end of a book's main content.
SECTION_WORDS = ["chapter", "part", "book"]

# Character attributes.
OPERATIONS = ["insert", "update", "merge"]
AGES = ["child", "adult", "elderly"]
GENDERS = ["male", "female", "unknown"]
NO_NAME = ["none", "null", "n/a", "unknown"]
SCORE_LEGEND = {
    "1": "completely masculine",
    "2": "mostly masculine",
    "3": "moderately masculine",
    "4": "slightly masculine",
    "5": "neutral/unknown",
    "6": "slightly feminine",
    "7": "moderately feminine",
    "8": "mostly feminine",
    "9": "almost completely feminine",
    "10": "completely feminine",
}
# (gender, age) -> the scores a character may get.
SCORE_CHOICES = {
    ("male", "child"): [4], ("male", "adult"): [1, 2, 3], ("male", "elderly"): [1, 2],
    ("female", "child"): [10], ("female", "adult"): [7, 8, 9], ("female", "elderly"): [6, 7],
}
NEUTRAL_SCORE = 5
# Every book's registry starts from these two.
SEED_CHARACTERS = [
    ("narrator", "adult", "female", 0, "The narrator of the story"),
    ("unknown", "adult", "unknown", 5, "Unknown or ambiguous speaker"),
]

# Output formats and narrator choices.
FORMATS = ["m4b", "aac", "m4a", "mp3", "wav", "opus", "flac", "pcm"]
NARRATOR_GENDERS = ["male", "female"]

# Voices by engine: score 0 to 10, then the narrator/dialogue pair of single-voice mode.
VOICE_SCORES = {
    ("kokoro", "male"): ["am_puck", "am_onyx", "am_michael", "am_echo", "am_fenrir+bf_alice",
                         "af_alloy+am_puck", "af_kore", "af_sky", "af_aoede+af_heart",
                         "af_sarah", "af_bella"],
    ("kokoro", "female"): ["af_heart", "am_onyx", "am_echo", "am_puck", "am_fenrir+bf_alice",
                           "af_alloy+am_puck", "af_kore", "af_sky", "af_aoede+af_heart",
                           "af_sarah", "af_bella"],
    ("orpheus", "male"): ["zac", "leo", "dan", "dan", "zac", "zoe", "jess", "tara", "tara",
                          "leah", "mia"],
    ("orpheus", "female"): ["tara", "leo", "dan", "zac", "zac", "zoe", "jess", "jess", "leah",
                            "leah", "mia"],
}
VOICE_PAIRS = {
    ("kokoro", "male"): ("am_puck", "af_alloy+am_puck"),
    ("kokoro", "female"): ("af_heart", "af_sky"),
    ("orpheus", "male"): ("zac", "dan"),
    ("orpheus", "female"): ("tara", "leah"),
}

# Engines whose lines are prepared before synthesis.
PREPARED_ENGINES = ["orpheus"]

# Message texts.
NO_CHARACTERS = "No characters identified yet."
NO_BEFORE = "[No previous context]"
NO_AFTER = "[No following context]"
NO_RESULTS = "No search results found for this book."
LINE_MARKER = " ||| "
