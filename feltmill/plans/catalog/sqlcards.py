"""SQL fragments shared by the reference queries on cards."""

from __future__ import annotations

RANKS = "23456789TJQKA"
SUITS = "shdc"

DECK_CTE = """
deckc AS (SELECT rr || ss AS c, (ri - 1) + 2 AS rk, si - 1 AS su, 1::BIGINT << CAST(13 * (si - 1) + ri - 1 AS INT) AS m
          FROM (SELECT unnest(['2','3','4','5','6','7','8','9','T','J','Q','K','A']) AS rr, unnest(range(1, 14)) AS ri),
               (SELECT unnest(['s','h','d','c']) AS ss, unnest(range(1, 5)) AS si))"""

PAIRS_CTE = "pairs AS (SELECT a.m | b.m AS m FROM deckc a JOIN deckc b ON a.m < b.m)"


def deal_cte(table: str, key: str, seed: int = 17, name: str = "dealt") -> str:
    """Cards of a row ordered by a digest: lists of card text, mask, rank and suit."""
    order = f"sha256('{seed}:' || {key} || ':' || c)"
    return (
        f"{name} AS (SELECT {key}, list(c ORDER BY {order}) AS d, list(m ORDER BY {order}) AS dm "
        f"FROM {table} CROSS JOIN deckc GROUP BY {key})"
    )


def high(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN 1::BIGINT << CAST(floor(log2({x}) + 1e-9) AS INT) ELSE 0 END)"


def straight(x: str) -> str:
    """Top rank of the best straight in a rank set, as one bit."""
    ext = f"((({x}) << 1) | (({x}) >> 12))"
    run = f"({ext} & ({ext} << 1) & ({ext} << 2) & ({ext} << 3) & ({ext} << 4) & 16383)"
    return f"({high(run)} >> 1)"


def score_sql(source: str, mask: str, out: str) -> str:
    """SELECT over `source` that adds the hand score of `mask` as `out`."""
    one = f"SELECT *, {mask} & 8191 AS q0, ({mask} >> 13) & 8191 AS q1, ({mask} >> 26) & 8191 AS q2, ({mask} >> 39) & 8191 AS q3 FROM {source}"
    two = f"""SELECT *, q0|q1|q2|q3 AS qa, (q0&q1)|(q0&q2)|(q0&q3)|(q1&q2)|(q1&q3)|(q2&q3) AS qt,
      (q0&q1&q2)|(q0&q1&q3)|(q0&q2&q3)|(q1&q2&q3) AS qh, q0&q1&q2&q3 AS qf,
      CASE WHEN bit_count(q0) >= 5 THEN q0 WHEN bit_count(q1) >= 5 THEN q1 WHEN bit_count(q2) >= 5 THEN q2
           WHEN bit_count(q3) >= 5 THEN q3 ELSE 0 END AS qx FROM ({one})"""
    three = f"""SELECT *, {straight('qx')} AS qsf, {straight('qa')} AS qs, {high('qh')} AS qh1, {high('qt')} AS qt1,
      CASE WHEN bit_count(qa) > 6 THEN (qa & (qa - 1)) & ((qa & (qa - 1)) - 1) WHEN bit_count(qa) > 5 THEN qa & (qa - 1) ELSE qa END AS qa5,
      CASE WHEN bit_count(qx) > 6 THEN (qx & (qx - 1)) & ((qx & (qx - 1)) - 1) WHEN bit_count(qx) > 5 THEN qx & (qx - 1) ELSE qx END AS qx5
      FROM ({two})"""
    four = f"""SELECT *, xor(qt, qh1) AS qfull, xor(qa, qh1) AS qk3, xor(qa, qt1) AS qk1, qt1 | {high('xor(qt, qt1)')} AS qt2 FROM ({three})"""
    five = f"""SELECT *, {high('qk3')} AS qk3a, xor(qa, qt2) AS qk2,
      CASE WHEN bit_count(qk1) > 4 THEN (qk1 & (qk1 - 1)) & ((qk1 & (qk1 - 1)) - 1) WHEN bit_count(qk1) > 3 THEN qk1 & (qk1 - 1) ELSE qk1 END AS qk1c
      FROM ({four})"""
    score = f"""CASE WHEN qsf > 0 THEN (8::BIGINT << 26) + qsf * 8192
      WHEN qf > 0 THEN (7::BIGINT << 26) + qf * 8192 + {high('xor(qa, qf)')}
      WHEN qh1 > 0 AND qfull > 0 THEN (6::BIGINT << 26) + qh1 * 8192 + {high('qfull')}
      WHEN qx > 0 THEN (5::BIGINT << 26) + qx5 * 8192
      WHEN qs > 0 THEN (4::BIGINT << 26) + qs * 8192
      WHEN qh1 > 0 THEN (3::BIGINT << 26) + qh1 * 8192 + (qk3a | {high('xor(qk3, qk3a)')})
      WHEN bit_count(qt) >= 2 THEN (2::BIGINT << 26) + qt2 * 8192 + {high('qk2')}
      WHEN qt > 0 THEN (1::BIGINT << 26) + qt * 8192 + qk1c
      ELSE qa5 * 8192 END"""
    hidden = "q0, q1, q2, q3, qa, qt, qh, qf, qx, qsf, qs, qh1, qt1, qa5, qx5, qfull, qk3, qk1, qt2, qk3a, qk2, qk1c"
    return f"SELECT * EXCLUDE ({hidden}), {score} AS {out} FROM ({five})"
