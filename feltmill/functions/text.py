"""Action text, labels, prompts and entity decoding as column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let, strip, to_double

# Action classes and what they mean as an intent.
FOUR_CLASSES = ("CHECK", "FOLD", "CALL", "RAISE")
INTENTS = ("NO_INVEST", "CALL", "RAISE")
INTENT_OF = {"CHECK": "NO_INVEST", "FOLD": "NO_INVEST", "CALL": "CALL", "RAISE": "RAISE"}

# Fixed patterns: action words, in the order they are tried.
CHECK_WORDS = r"\bcheck(?:s|ed|ing)?\b"
FOLD_WORDS = r"\bfold(?:s|ed|ing)?\b"
CALL_WORDS = r"\bcall(?:s|ed|ing)?\b"
RAISE_WORDS = r"\b(?:bet|bets|bett?ing|raise|raises|raised|all\s*in|allin|jam|jams|shove|shoves)\b"
SHORT_RAISE = r"^[br]\s*[0-9]+(?:\.[0-9]+)?$"
BARE_SIZE = r"^[0-9]+(?:\.[0-9]+)?(?:\s*(?:bb|chips?))?$"
BET_SIZE = r"(?:bet|raise|raises\s+to|raised\s+to|all\s*in|allin|jam|shove|[br])\s*(?:to\s*)?([0-9]+(?:\.[0-9]+)?)"

# Fixed patterns: fields of a prompt.
POT_FIELD = r"current pot size is\s*([0-9]+(?:\.[0-9]+)?)"
STACK_FIELD = r"current stack:\s*([0-9]+(?:\.[0-9]+)?)"
EV_FIELD = r"Your EV:\s*(-?[0-9]+(?:\.[0-9]+)?)"
EQUITY_FIELD = r"Your equity:\s*([0-9]+(?:\.[0-9]+)?)\s*%"
POSITION_FIELD = r"your position is\s*([A-Z]{2,3})"
LEGAL_FIELD = r"Legal actions:\s*([^\n.]+(?:\.[^\n]*)?)"
SUMMARY_FIELD = r"Here is a game summary:\s*(.*?)\n\s*Now it is your turn"


def _entity_tables() -> tuple[dict[str, str], list[str]]:
    """Named entities from the standard list, and the names valid without a semicolon."""
    closed = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
    bare = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
    return closed, bare


def unescape_entities(c: Column) -> Column:
    """Decode named and numeric character references over the whole text.

    Rows without an ampersand skip the work. The others are cut at the references, each reference
    is looked up once in a literal map, and the pieces are joined again.
    """
    closed, bare = _entity_tables()
    bare_alt = "|".join(bare)
    pattern = f"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{bare_alt}))"
    # One JSON literal; the optimizer folds it into one map constant.
    names = F.from_json(F.lit(json.dumps(closed)), "map<string,string>")

    def decode(ref: Column) -> Column:
        name = F.regexp_replace(ref, r"^&|;$", "")
        hexed = F.regexp_extract(ref, r"^&#[xX]([0-9a-fA-F]+)", 1)
        digits = F.regexp_extract(ref, r"^&#([0-9]+)", 1)
        point = F.when(hexed != "", F.conv(hexed, 16, 10)).when(digits != "", digits).try_cast("bigint")
        usable = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
        char = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(F.lit("�"))
        prefix = F.regexp_extract(ref, f"^&({bare_alt})", 1)
        rest = F.substr(ref, F.length(prefix) + 2)
        return F.when(point.isNotNull(), char).otherwise(
            F.coalesce(
                F.try_element_at(names, name),
                F.when(prefix != "", F.concat(F.try_element_at(names, prefix), rest)),
                ref,
            )
        )

    def joined(text: Column) -> Column:
        decoded = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), decode)
        gaps = F.split(text, pattern, -1)
        whole = F.array_join(F.zip_with(gaps, decoded, lambda gap, char: F.concat(gap, F.coalesce(char, F.lit("")))), "")
        return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)

    return let(c, joined)


def clean_action(c: Column, entities: bool = True) -> Column:
    """Readable action text: entities decoded, the <action> body if there is one, tags and joins removed."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    tagged = r"(?is)<\s*action\s*>(.*?)<\s*/\s*action\s*>"

    def cleaned(t: Column) -> Column:
        body = F.when(t.rlike(tagged), F.regexp_extract(t, tagged, 1)).otherwise(t)
        plain = F.translate(F.regexp_replace(body, "<[^>]+>", " "), "_-", "  ")
        return strip(F.regexp_replace(plain, r"(?U)\s+", " "))

    return let(strip(unescape_entities(text) if entities else text), cleaned)


def action_class(cleaned: Column) -> Column:
    """CHECK / FOLD / CALL / RAISE of a cleaned action text, null when nothing fits."""

    def classed(low: Column) -> Column:
        return (
            F.when(low == "", F.lit(None).cast("string"))
            .when(low.rlike(CHECK_WORDS) | low.isin("k", "x"), F.lit("CHECK"))
            .when(low.rlike(FOLD_WORDS) | (low == "f"), F.lit("FOLD"))
            .when(low.rlike(CALL_WORDS) | (low == "c"), F.lit("CALL"))
            .when(low.rlike(RAISE_WORDS) | low.rlike(SHORT_RAISE) | low.rlike(BARE_SIZE), F.lit("RAISE"))
        )

    return let(F.lower(cleaned), classed)


def intent_of(action: Column) -> Column:
    """Intent of one of the four classes, null outside them."""
    return let(action, lambda a: F.when(a.isin("CHECK", "FOLD"), F.lit("NO_INVEST")).when(a.isin("CALL", "RAISE"), a))


def action_of_intent(intent: Column, can_check: Column) -> Column:
    """Playable action of an intent; null for anything that is not an intent."""
    up = F.upper(intent)
    return (
        F.when(up == "NO_INVEST", F.when(can_check, F.lit("CHECK")).otherwise(F.lit("FOLD")))
        .when(up.isin("CALL", "RAISE"), up)
    )


def bet_size(cleaned: Column) -> Column:
    def sized(low: Column) -> Column:
        worded = F.nullif(F.regexp_extract(low, BET_SIZE, 1), F.lit(""))
        bare = F.nullif(F.regexp_extract(low, r"^([0-9]+(?:\.[0-9]+)?)$", 1), F.lit(""))
        return F.coalesce(worded, bare).try_cast("double")

    return let(F.lower(cleaned), sized)


def hand_record_amount(action: Column) -> Column:
    """Second token of a hand-record action as a number."""
    return to_double(F.try_element_at(F.split(strip(action), r"\s+"), F.lit(2)), "blank")


def button_amount(action: Column) -> Column:
    """First number anywhere in an action label such as BET_33."""
    return F.nullif(F.regexp_extract(action, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def oracle_label(c: Column) -> Column:
    """Label of a scenario row; text that fits no class is returned in upper case."""
    text = F.upper(strip(F.coalesce(c.cast("string"), F.lit(""))))
    head = F.regexp_replace(F.try_element_at(F.split(text, r"(?U)\s+"), F.lit(1)), "_", " ")
    raised = head.isin("BET", "RAISE") | text.startswith("RAISE") | text.startswith("BET")
    sized = text.rlike(r"^[0-9]+(?:\.[0-9]+)?(?:\s*BB)?$")
    return F.when(head.isin("CHECK", "FOLD", "CALL"), head).when(raised | sized, F.lit("RAISE")).otherwise(text)


def solver_action(c: Column) -> Column:
    """Run-log action to CHECK / FOLD / CALL / RAISE; all-in and unknown actions are null."""
    up = F.translate(F.upper(c), "- ", "__")
    return F.when(up.isin("CHECK", "FOLD", "CALL"), up).when(up.startswith("BET_") | up.startswith("RAISE_"), F.lit("RAISE"))


# Label aliases of the live snapshots, and the sized actions the live export knows.
LIVE_ALIASES = {"COL": "CALL", "CALL": "CALL", "RES": "RAISE", "BET": "RAISE", "MISE": "RAISE", "RELANCE": "RAISE"}
LIVE_SIZED = (
    "BET", "BET_33", "BET_75", "BET_100", "BET_150", "BET_200",
    "RAISE", "RAISE_33", "RAISE_75", "RAISE_100", "RAISE_150", "RAISE_200",
)


def live_label(c: Column) -> Column:
    up = F.upper(strip(F.coalesce(c.cast("string"), F.lit(""))))
    aliased = F.lit(None).cast("string")
    for word, label in LIVE_ALIASES.items():
        aliased = F.coalesce(aliased, F.when(up == word, F.lit(label)))
    return F.coalesce(aliased, up)


def live_solver_action(c: Column) -> Column:
    up = F.translate(F.upper(strip(F.coalesce(c.cast("string"), F.lit("")))), "- ", "__")
    return (
        F.when(up.isin(*LIVE_SIZED), F.lit("RAISE"))
        .when(up.isin("CHECK_CALL", "CALL"), F.lit("CALL"))
        .when(up == "ALLIN", F.lit("ALL_IN"))
        .otherwise(live_label(up))
    )


def price_from_legal(legal: Column) -> Column:
    """Amount after 'call' in a legal-action text, else 0."""
    low = F.lower(F.coalesce(legal, F.lit("")))
    return F.coalesce(F.regexp_extract(low, r"call\s+([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def price_from_history(can_call: Column, history: Column) -> Column:
    """Last bet in the history when a call is possible, 1.0 when no amount is written, else 0."""
    amounts = F.regexp_extract_all(F.upper(F.coalesce(history, F.lit(""))), F.lit(r"(?:BET|RAISE|/)([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    last = F.try_element_at(amounts, F.lit(-1)).try_cast("double")
    return F.when(can_call, F.greatest(F.lit(0.0), F.coalesce(last, F.lit(1.0)))).otherwise(F.lit(0.0))


# Fixed patterns: words counted in an action history.
HISTORY_WORDS = {
    "check": r"\bcheck(?:ed)?\b",
    "call": r"\bcall(?:ed)?\b",
    "fold": r"\bfold(?:ed)?\b",
    "bet_raise": r"\b(?:bet|bets|raised?|all-in|allin)\b",
}
HISTORY_PARTS = {"check": ("CHECK",), "call": ("CALL",), "fold": ("FOLD",), "bet_raise": ("BET", "RAISE", "ALLIN")}


def history_word_counts(history: Column) -> dict[str, Column]:
    """Whole-word counts over the lower-cased history."""
    low = F.lower(F.coalesce(history, F.lit("")))
    return {name: F.regexp_count(low, F.lit(pattern)) for name, pattern in HISTORY_WORDS.items()}


def history_part_counts(history: Column) -> dict[str, Column]:
    """Plain substring counts over the upper-cased history."""
    up = F.upper(F.coalesce(history, F.lit("")))

    def occurrences(word: str) -> Column:
        return F.try_divide(F.length(up) - F.length(F.replace(up, F.lit(word), F.lit(""))), F.lit(len(word))).cast("int")

    counts = {}
    for name, words in HISTORY_PARTS.items():
        total = occurrences(words[0])
        for word in words[1:]:
            total = total + occurrences(word)
        counts[name] = total
    return counts


def legal_moves(c: Column) -> Column:
    """Move list from a bracketed list of quoted words, else from comma-separated text."""
    text = strip(F.coalesce(c, F.lit("")))
    quoted = F.from_json(F.translate(text, "'", '"'), "array<string>")
    pieces = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    return F.coalesce(F.when(text.startswith("["), quoted), pieces)


def has_move(moves: Column, *prefixes: str) -> Column:
    def hit(move: Column) -> Column:
        up = F.upper(F.trim(move))
        found = up.startswith(prefixes[0])
        for prefix in prefixes[1:]:
            found = found | up.startswith(prefix)
        return found

    return F.exists(moves, hit)


def has_raise_move(moves: Column) -> Column:
    return has_move(moves, "BET", "RAISE", "ALLIN", "ALL-IN")


def prompt_number(prompt: Column, pattern: str) -> Column:
    return F.regexp_extract(prompt, "(?i)" + pattern, 1).try_cast("double")


def prompt_text(prompt: Column, pattern: str) -> Column:
    found = F.regexp_extract(prompt, "(?i)" + pattern, 1)
    return F.when(prompt.rlike("(?i)" + pattern), strip(found))


def prompt_legal(prompt: Column) -> Column:
    return prompt_text(prompt, LEGAL_FIELD)


def prompt_history(prompt: Column) -> Column:
    pattern = "(?is)" + SUMMARY_FIELD
    body = F.regexp_extract(prompt, pattern, 1)
    return F.when(prompt.rlike(pattern), strip(F.regexp_replace(body, r"(?U)\s+", " ")))


def prompt_street(prompt: Column) -> Column:
    low = F.lower(F.coalesce(prompt, F.lit("")))
    street = F.when(low.contains("before the flop") | low.contains("preflop"), F.lit("PREFLOP"))
    for name in ("flop", "turn", "river"):
        street = street.when(low.rlike(rf"\b{name}\b"), F.lit(name.upper()))
    return street


def prompt_position(prompt: Column) -> Column:
    return F.upper(prompt_text(prompt, POSITION_FIELD))


def heads_up_villain(position: Column) -> Column:
    up = F.upper(position)
    return F.when(up == "SB", F.lit("BB")).when(up == "BB", F.lit("SB"))


# Plain names of the numbered actions, and where the sized ones start.
ACTION_NAMES = {0: "FOLD", 1: "CHECK", 2: "CALL", 13: "ALL_IN"}
FIRST_BET, FIRST_RAISE, SIZES = 3, 8, 5


def action_label(action_id: Column, fractions: Column) -> Column:
    """Name of a numbered action; sized actions carry their pot fraction in percent (BET_33, RAISE_12_5)."""

    def sized(kind: str, first: int) -> Column:
        percent = F.try_element_at(fractions, (action_id - first + 1).cast("int")) * 100.0
        whole = F.abs(percent - F.bround(percent, 0)) < 1e-9
        exact = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", percent), r"0+$", ""), r"\.$", "")
        text = F.when(whole, F.bround(percent, 0).cast("bigint").cast("string")).otherwise(F.replace(exact, F.lit("."), F.lit("_")))
        return F.concat(F.lit(kind + "_"), text)

    label = F.when(action_id.between(FIRST_BET, FIRST_BET + SIZES - 1), sized("BET", FIRST_BET)).when(
        action_id.between(FIRST_RAISE, FIRST_RAISE + SIZES - 1), sized("RAISE", FIRST_RAISE)
    )
    for number, name in ACTION_NAMES.items():
        label = label.when(action_id == number, F.lit(name))
    return label.otherwise(F.concat(F.lit("ACTION_"), action_id.cast("string")))
