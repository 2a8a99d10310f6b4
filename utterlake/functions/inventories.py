"""Label inventories that texts are segmented with."""

from __future__ import annotations

# An orthographic inventory of single phonemes, doubled stops and diphthongs.
BASIC = "a b d dj rd e h i k l rl m n ng nj rn o r rr u w y".split()
DOUBLED_STOPS = "bb dd djdj rdd kk".split()
DIPHTHONGS = "ay aw ey ew iw oy ow uy".split()
ORTHOGRAPHIC = BASIC + DOUBLED_STOPS + DIPHTHONGS

# A tonal inventory; phones of one, two and three code points, in alphabetical order of code points.
ONE = "b c d e f g h i j k l m n o p q s t u v w z æ õ ĩ ŋ ɑ ɔ ɕ ɖ ə ɛ ɣ ɤ ɬ ɭ ɯ ɲ ɳ ɻ ʁ ʂ ʈ ʐ ʑ ʝ ẽ".split()
TWO = (
    "ã dz dʑ ẽ ĩ i͂ jo jæ jɤ kʰ õ o̥ pʰ qʰ ts tɕ tʰ ṽ v̩ wæ wɑ wɤ w̃ "
    "æ̃ ɑ̃ ɖʐ ə̃ ɤ̃ ɻ̃ ɻ̍ ɻ̩ ʈʂ ʈʰ"
).split()
THREE = "tsʰ tɕʰ ṽ̩ ṽ̩ wæ̃ w̃æ ɻ̩̃ ʈʂʰ".split()
FILLERS = ["əəə…", "mmm…"]
LEVEL_TONES = ["˥", "˧", "˩"]
CONTOUR_TONES = ["˧˥", "˧˩", "˩˥", "˩˧"]
TONE_GROUP = "|"
# What the tonal texts may hold beside phones and tones and is left out.
SYMBOLS = "# $ : = D F a ~ ¨ « » ː “ ” ‡ … ↑ ! \" ' * , . ; ? ʔ - ʰ / < > ( )".split()
TONE_GROUP_MARKS = ["|", "ǀ", "◊"]

TONAL_PHONEMES = ONE + TWO + THREE + FILLERS
TONES = LEVEL_TONES + CONTOUR_TONES
#: Label type -> (phonemes, tones, tone group mark).
TONAL_TYPES = {
    "phonemes_and_tones": (True, True, True),
    "phonemes_and_tones_no_tgm": (True, True, False),
    "phonemes": (True, False, False),
    "tones": (False, True, True),
    "tones_notgm": (False, True, False),
}


def tonal_labels(label_type: str) -> list[str]:
    """Every label that texts of ``label_type`` may hold."""
    if label_type not in TONAL_TYPES:
        raise ValueError(f"unrecognized label type: {label_type}")
    phonemes, tones, group = TONAL_TYPES[label_type]
    return TONAL_PHONEMES * phonemes + TONES * tones + [TONE_GROUP] * group
