"""SQL expressions for what transcribers write into a text beside the speech: times, annotations, hesitation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Written-in times: <t=17.9>, [2m00s], [00:11:44], (5:07), 00:02:56,233 -->, 07:04 -
TIMES = r"<t=[\d.]+>|\[\d+m\d+s\]|[\[(]?(?<!\d)\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?(?!\d)[\])]?(?:\s*-->|\s+-(?=\s|$))?"
#: Marked noise in any of the bracket styles, and music signs.
ANNOTATIONS = r"\[+[^\]]*\]+|\(+[^)]*\)+|\{+[^}]*\}+|<[^>]*>|【[^】]*】|〔[^〕]*〕|〈[^〉]*〉|《[^》]*》|\*[^*]+\*|=[^=]+=|♪"
# Hesitation and listening sounds, each letter of which may be drawn out.
SOUNDS = ["u+h+-?huh+", "m+-?h+m+", "u+h*m*", "h+u*m+", "m{2,}h*", "m+h+", "e+u+h*", "h+e+u+", "e+r+m*", "e+h*m+", "e{2,}h*", "e+h+", "ə{2,}", "a+h+", "嗯+", "呃+", "唔+"]
_WORD = r"\p{L}\p{M}\p{N}'’ʼ"
HESITATION = rf"(?iu)(?<![{_WORD}])(?:{'|'.join(SOUNDS)})(?![{_WORD}])"
_NAME = r"\p{L}[\p{L}\p{M}., _'’ʼ\-]*"
_CODE = r"\p{L}*\d[\p{L}\p{N}]*"
#: A name or a code of a speaker in front of the speech: [S0000109], <Vala Lutopave>, S0000241>, >> R. Mudamuba:, Dimeseno, Neso -
#: Whether it is anybody's is told by the table of speakers, so names of any length and codes of any shape may match.
WRITTEN = rf"^[\s>\-–—.…]*(?:[\[<(]\s*(?:{_CODE}|{_NAME})\s*[\]>)]|(?:{_CODE}|{_NAME}?)\s*(?::(?!\d)|>|\s-(?=\s|$)))"


#: Letters that a hesitation sound may be made of; any other letter is speech.
_SOUND_LETTERS = "uhmeraəUHMERAƏ嗯呃唔"
#: What may close a written-in name.
_CLOSES = r"[:>\])]| -"


def says_speech(text: Column) -> Column:
    """Whether a word beside hesitation sounds remains; most texts are settled by one scan for other letters."""
    return F.when(text.rlike(rf"[\p{{L}}\p{{N}}&&[^{_SOUND_LETTERS}]]"), True).otherwise(says_something(without_hesitation(text)))


def written_front(text: Column) -> Column:
    """The part of ``text`` up to the end of a name or code written in front, empty if there is none."""
    return F.when(text.rlike(_CLOSES), F.regexp_extract(text, WRITTEN, 0)).otherwise("")


def without_times(text: Column) -> Column:
    return F.when(text.rlike(r"\d"), F.regexp_replace(text, TIMES, " ")).otherwise(text)


def without_annotations(text: Column) -> Column:
    return F.when(text.rlike(r"[\[({<【〔〈《*=♪]"), F.regexp_replace(text, ANNOTATIONS, " ")).otherwise(text)


def without_hesitation(text: Column) -> Column:
    return F.regexp_replace(text, HESITATION, "")


def says_something(text: Column) -> Column:
    """Whether a letter or a figure remains."""
    return text.rlike(r"[\p{L}\p{N}]")


def tidy(text: Column) -> Column:
    """Spaces and punctuation left over by removals put right."""
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r"(?:[,;]\s*)+(?=[,.!?;:。！？])|\s+(?=[,.!?;:](?:\s|$))", "")
    return F.trim(F.regexp_replace(text, r"^[\s,;:.…>\-–—]+", ""))
