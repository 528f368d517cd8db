"""Pot arithmetic shared by the exports. Every rule that differs between exports is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import clamp, half_even, ratio

INFINITY = float("inf")


def pot_ratio(amount: Column, pot: Column, digits: int = 10) -> Column:
    """amount / pot, null without a positive pot."""
    return ratio(amount, pot, digits)


def equity_required(pot: Column, to_call: Column, digits: int | None = 10) -> Column:
    """Share of the final pot that the call costs; null when the final pot is not positive."""
    return ratio(to_call, pot + to_call, digits)


def expected_value(equity: Column, pot: Column, to_call: Column, digits: int | None = 10) -> Column:
    value = equity * (pot + to_call) - to_call
    return value if digits is None else half_even(value, digits)


def call_max(equity: Column, pot: Column, sure: str = "clamp", digits: int | None = 10) -> Column:
    """Largest break-even call. `sure` says what equity 1 gives: 'clamp' (at 0.999999), 'inf', or 'cap' (500)."""
    e = clamp(equity, 0.0, 0.999999) if sure == "clamp" else equity
    value = F.try_divide(e * pot, F.lit(1.0) - e)
    value = value if digits is None else half_even(value, digits)
    if sure == "clamp":
        return value
    top = F.lit(INFINITY if sure == "inf" else 500.0)
    return F.when(equity.isNull() | pot.isNull(), F.lit(None).cast("double")).when(equity >= 1, top).otherwise(value)


def multiway_equity(heads_up: Column, opponents: Column) -> Column:
    return half_even(clamp(F.pow(heads_up, F.greatest(F.lit(1), opponents)), 0.0, 1.0), 10)


def equity_gap(equity: Column, required: Column, missing: float | None = None) -> Column:
    gap = equity - required
    return gap if missing is None else F.coalesce(gap, F.lit(missing))


# Button states that count as check, call and raise.
CHECK_STATES = ("check",)
CALL_STATES = ("paie", "call")
RAISE_STATES = ("mise", "relance", "raise", "all-in")
# Words in a button text and the state they mean, in the order they are tried.
BUTTON_WORDS = (
    (("all-in", "all in"), "all-in"),
    (("relance", "raise"), "relance"),
    (("mise", "bet"), "mise"),
    (("paie", "call"), "paie"),
    (("check",), "check"),
    (("fold", "couche"), "fold"),
)


def button_state(button: Column) -> Column:
    """State of a button struct: the recorded state, else read from its text."""
    low = F.lower(button["text"])
    read = F.lit(None).cast("string")
    for words, state in BUTTON_WORDS:
        hit = low.contains(words[0])
        for word in words[1:]:
            hit = hit | low.contains(word)
        read = F.coalesce(read, F.when(hit, F.lit(state)))
    return F.coalesce(F.nullif(F.lower(button["state"]), F.lit("")), read)


def active_buttons(buttons: Column) -> Column:
    """States of the enabled buttons in order; a button without a flag counts when it has a text."""
    usable = F.filter(
        F.coalesce(buttons, F.array()),
        lambda b: F.coalesce(b["enabled"], F.length(b["text"]) > 0, F.lit(False)),
    )
    return F.filter(F.transform(usable, button_state), lambda s: s.isNotNull())


def has_button(buttons: Column, states: tuple[str, ...]) -> Column:
    """Whether an enabled button has one of the states; null when there are no buttons at all."""
    return F.when(F.size(buttons) > 0, F.arrays_overlap(active_buttons(buttons), F.array(*[F.lit(s) for s in states])))


# Looseness and aggression by the last action of an opponent.
DEFAULT_PROFILE = (0.55, 0.35)
ACTION_PROFILES = {
    "paid": (0.36, 0.68), "call": (0.36, 0.68), "paie": (0.36, 0.68),
    "raise": (0.24, 0.92), "relance": (0.24, 0.92), "mise": (0.24, 0.92), "all-in": (0.24, 0.92),
    "check": (0.58, 0.32), "play": (0.58, 0.32),
}


def opponent_profiles(players: Column) -> Column:
    """Profile structs of the players still in: action class, recent change and invested share move them.

    The first pass reads every player once into plain fields, the second computes from those.
    """
    entries = ", ".join(f"'{k}', named_struct('l', {l}D, 'a', {a}D)" for k, (l, a) in ACTION_PROFILES.items())
    by_action = F.expr(f"map({entries})")
    default = F.expr(f"named_struct('l', {DEFAULT_PROFILE[0]}D, 'a', {DEFAULT_PROFILE[1]}D)")

    def invested(start: Column, now: Column) -> Column:
        return F.when((start != 0) & (now < start), F.try_divide(start - now, start)).otherwise(0.0)

    named = F.transform(
        F.coalesce(players, F.array()),
        lambda p, i: F.struct(
            F.coalesce(F.nullif(p["name"], F.lit("")), F.concat(F.lit("J"), (i + 1).cast("string"))).alias("name"),
            F.lower(F.coalesce(F.nullif(p["state"], F.lit("")), F.lit("play"))).alias("action"),
            invested(p["stack_start"], p["stack"]).alias("invested"),
            F.when(p["changed_this_round"], 0.08).otherwise(0.0).alias("changed"),
            F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence"),
            F.coalesce(p["active"], F.lit(True)).alias("still_in"),
        ),
    )
    based = F.transform(
        F.filter(named, lambda p: p["still_in"]),
        lambda p: F.struct(p.alias("p"), F.coalesce(F.try_element_at(by_action, p["action"]), default).alias("base"), clamp(p["invested"], 0.0, 1.0).alias("share")),
    )
    return F.transform(
        based,
        lambda b: F.struct(
            b["p"]["name"].alias("name"),
            clamp(b["base"]["l"] - b["share"] * 0.10, 0.0, 1.0).alias("looseness"),
            clamp(b["base"]["a"] + b["p"]["changed"] + b["share"] * 0.18, 0.0, 1.0).alias("aggression"),
            b["p"]["action"].alias("action"),
            b["p"]["confidence"].alias("confidence"),
        ),
    )


def padded_profiles(profiles: Column, count: Column) -> Column:
    """Exactly `count` profiles: the first ones, then default ones named opponent_n."""
    have = F.slice(profiles, 1, F.greatest(count, F.lit(0)))
    missing = F.greatest(count - F.size(have), F.lit(0))
    extra = F.transform(
        F.slice(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), F.size(have) + 1, missing),
        lambda i: F.struct(
            F.concat(F.lit("opponent_"), i.cast("string")).alias("name"),
            F.lit(DEFAULT_PROFILE[0]).alias("looseness"),
            F.lit(DEFAULT_PROFILE[1]).alias("aggression"),
            F.lit("play").alias("action"),
            F.lit(0.0).alias("confidence"),
        ),
    )
    return F.concat(have, extra)
