"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public English stop words of scikit-learn, without the negations.
_STOP = """
a about above across after afterwards again against all almost alone along already also although always am among
amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became
because become becomes becoming been before beforehand behind being below beside besides between beyond bill both
bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during each eg eight
either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty
fill find fire first five for former formerly forty found four from front full further get give go had has hasnt have
he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc
indeed interest into is it its itself keep last latter latterly least less ltd made many may me meanwhile might mill
mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody
none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves
out over own part per perhaps please put rather re same see seem seemed seeming seems serious several she should show
side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such system take ten
than that the their them themselves then thence there thereafter thereby therefore therein thereupon these they thick
thin third this those though three through throughout thru thus to together too top toward towards twelve twenty two
un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas
whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within
without would yet you your yours yourself yourselves
"""
NEGATIONS = ("cannot", "never", "no", "none", "not")
STOP_WORDS = tuple(w for w in _STOP.split() if w not in NEGATIONS)

# White space as Python's patterns know it, which Java's own class is not; and the patterns that results depend on.
SPACE_CHARS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = f"[{SPACE_CHARS}]"
SENTENCE_END = rf"(?<=[.!?]){SPACE}+(?=[A-Z0-9])"
LOOSE_END = rf"(?<=[.!?]){SPACE}+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
HEADINGS = rf"references|bibliography|works{SPACE}+cited|literature{SPACE}+cited|reference{SPACE}+list"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?<!{SPACE}){SPACE}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+", "")


def tokens(c: Column) -> Column:
    """Lower-cased word tokens of two characters or more, stop words left out, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def word_count_tokens(c: Column) -> Column:
    """Token count without a tokenizer: twice the number of words."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(2 * F.size(F.split(s, f"{SPACE}+")))


def highlight(context: Column, start: Column, end: Column) -> Column:
    """Parts of a context before, in and after a span; without a real span the whole context comes first."""
    none = (start < 0) | (end <= start)
    return F.struct(
        F.when(none, context).otherwise(F.substring(context, F.lit(1), start)).alias("before"),
        F.when(none, "").otherwise(F.substring(context, start + 1, end - start)).alias("marked"),
        F.when(none, "").otherwise(F.substring(context, end + 1, F.length(context))).alias("after"),
    )
