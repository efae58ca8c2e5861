"""Profit, confidence, liquidity and verdict ladders as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import clamp, js_round, ladder, or_else

#: What a buyer pays on top, and the sale's share and costs.
BUYING, SALE_SHARE, SHIPPING = 3.5, 0.84, 4.5
#: Fixed values of the detailed fees: (rates, fixed amount, shipping).
FEES = {"ebay": (0.13 + 0.03 + 0.02, 0.30, 4.5), "cardmarket": (0.05 + 0.03, 0.0, 4.5)}
#: Fixed values of a settlement: rate and fixed part; a rate of zero counts as missing.
SETTLEMENT = {"ebay": (0.18, 0.30), "vinted": (0.05, 0.0), "cardmarket": (0.08, 0.0), "leboncoin": (0.0, 0.0)}
DEFAULT_RATE = 0.13
#: Tiers of capital from so much on, dearest purchase, wanted margin.
TIERS = ((1, 0, 20, 50), (2, 1000, 50, 40), (3, 2500, 150, 35), (4, 5000, 500, 30))


def total_cost(buyer: Column, listed: Column) -> Column:
    return or_else(buyer, listed) + BUYING


def net_sale(average: Column) -> Column:
    return average * SALE_SHARE - SHIPPING


def reliability(n: Column) -> Column:
    return ladder(n, [(">=", 3, "high"), (">=", 2, "medium")], "low")


def detailed_net(price: Column, platform: str) -> Column:
    rate, fixed, shipping = FEES[platform]
    return price * (1 - rate) - fixed - shipping


def opportunity(profit: Column, percent: Column, least_profit: Column, least_percent: Column) -> Column:
    return F.coalesce((profit >= least_profit) & (percent >= least_percent), F.lit(False))


def gate(profit: Column, percent: Column, confidence: Column, liquidity: Column) -> Column:
    """Hard gates reject, soft ones make a candidate."""
    return F.when((profit < 5) | (percent < 20), "reject").when((confidence >= 50) & (liquidity >= 40), "opportunity").otherwise("candidate")


def seller_score(reputation: Column, feedback: Column, items: Column) -> Column:
    """0 to 100; null only if nothing is known."""
    rep = F.coalesce(reputation, F.lit(0.5))
    f = ladder(F.coalesce(feedback, F.lit(0)), [("<=", 0, 10), ("<=", 5, 30), ("<=", 20, 50), ("<=", 50, 70)], 90)
    i = ladder(F.coalesce(items, F.lit(0)), [("<=", 0, 10), ("<=", 5, 30), ("<=", 20, 60)], 90)
    known = reputation.isNotNull() | feedback.isNotNull() | items.isNotNull()
    return F.when(known, js_round(rep * 100 * 0.4 + f * 0.3 + i * 0.3, 0).cast("long"))


def volume_step(n: Column) -> Column:
    return ladder(n, [("<=", 0, 0), ("<=", 2, 15), ("<=", 5, 30), ("<=", 10, 60), ("<=", 20, 80)], 100)


def speed_step(n_dated: Column, mean_interval: Column) -> Column:
    steps = ladder(mean_interval, [("<", 1, 100), ("<", 3, 80), ("<", 7, 60), ("<", 14, 40)], 20)
    return F.when(n_dated < 2, 50).when(mean_interval.isNull(), 100).otherwise(steps)


def stability_step(cv: Column) -> Column:
    return F.when(cv.isNull(), 50).otherwise(ladder(cv, [("<", 0.1, 100), ("<", 0.2, 80), ("<", 0.3, 60), ("<", 0.5, 40)], 20))


def turnover_step(ratio: Column, total: Column) -> Column:
    steps = ladder(ratio, [(">=", 0.7, 100), (">=", 0.5, 80), (">=", 0.3, 60), (">=", 0.1, 40)], 20)
    return F.when((total >= 3) & ratio.isNotNull(), steps).otherwise(50)


def liquidity(volume: Column, speed: Column, stability: Column, turnover: Column) -> Column:
    return js_round(volume * 0.35 + speed * 0.30 + stability * 0.20 + turnover * 0.15, 0).cast("long")


def five_tiers(score: Column, names: tuple[str, ...] = ("very_high", "high", "medium", "low", "very_low")) -> Column:
    return ladder(score, [(">=", b, n) for b, n in zip((80, 60, 40, 20), names, strict=False)], names[4])


def text_points(match_score: Column, from_ebay: Column) -> Column:
    return F.when(match_score >= 12, 40).when((match_score >= 8) & from_ebay, 40).when(match_score >= 8, 30).when((match_score >= 4) & from_ebay, 25).when(match_score >= 4, 20).otherwise(10)


def source_points(source: Column, n: Column) -> Column:
    """Trust in where prices come from; a single observation costs ten points."""
    base = (
        F.when(source == "niche-api", 20)
        .when(source == "browse-api", F.when(n >= 3, 20).otherwise(10))
        .when(source.isin("ebay", "ebay-html"), F.when(n >= 3, 15).otherwise(8))
        .when(source == "local-db", F.when(n >= 3, 15).when(n >= 2, 10).otherwise(5))
        .when(source == "stale", 3)
        .otherwise(5)
    )
    return F.when(n == 1, F.greatest(F.lit(0), base - 10)).otherwise(base)


def vision_points(verdict: Column, given: Column, image: Column) -> Column:
    """What the picture check adds; 'false' is handled by the caller, as it ends the score."""
    sure = js_round(25 + (clamp(F.coalesce(given, F.lit(90.0)), 60.0, 100.0) - 60) * 25 / 40, 0)
    maybe = js_round(10 + (clamp(F.coalesce(given, F.lit(45.0)), 20.0, 55.0) - 20) * 15 / 35, 0)
    local = ladder(image, [(">=", 0.85, 25.0), (">=", 0.75, 15.0)], 0.0)
    return F.when(verdict == "true", sure).when(verdict == "uncertain", maybe).otherwise(local)


def confidence(text: Column, source: Column, vision: Column, verdict: Column, comparable: Column, used: Column, penalty: Column, seller: Column, n: Column, niche: Column) -> Column:
    """Caps in their order: sum to 100, learned penalty, doubtful seller, single observation, no strong signal."""
    ran = verdict.isNotNull()
    worn = ran & ~F.coalesce(comparable, F.lit(True))
    v = F.when(worn, F.floor(vision / 2)).otherwise(vision)
    s = F.when(worn & used, F.greatest(F.lit(0), source - 10)).otherwise(source)
    total = F.greatest(F.lit(0), F.least(F.lit(100), text + s + v) + F.coalesce(penalty, F.lit(0)))
    strong = F.coalesce(verdict == "true", F.lit(False)) | ((text >= 30) & (s >= 15) & (v >= 15))
    # a cap that doesn't hold is null, which least passes over; so the total is named once and not once a cap
    caps = [F.when(seller < 20, 40), F.when((n < 2) & ~niche, 45), F.when(~strong, 59)]
    return F.when(F.coalesce(verdict == "false", F.lit(False)), 0).otherwise(F.least(total, *caps)).cast("long")


def vision_verdict(product: Column, variant: Column, condition: Column, given: Column) -> tuple[Column, Column]:
    """(verdict, confidence) from the model's answers."""
    no, yes = (product == "false") | (variant == "false"), (product == "true") & (variant == "true")
    verdict = F.when(F.coalesce(no, F.lit(False)), "false").when(F.coalesce(yes, F.lit(False)), "true").otherwise("uncertain")
    sure = F.when(F.coalesce(condition, F.lit(True)), clamp(F.coalesce(given, F.lit(90.0)), 60.0, 100.0)).otherwise(clamp(F.coalesce(given, F.lit(60.0)), 40.0, 70.0))
    return verdict, F.when(verdict == "false", 0.0).when(verdict == "true", sure).otherwise(clamp(F.coalesce(given, F.lit(45.0)), 20.0, 55.0))


def agent_volume(n30: Column, ratio: Column, n7: Column) -> Column:
    base = F.when(n30 >= 10, 100.0).when(n30 >= 6, 75 + (n30 - 6) * 6.25).when(n30 >= 3, 40 + (n30 - 3) * 11.67).when(n30 >= 1, 10 + (n30 - 1) * 15.0).otherwise(0.0)
    return F.when((ratio > 0.4) & (n7 >= 2), F.least(F.lit(100.0), base + 10)).otherwise(base)


def agent_speed(d: Column) -> Column:
    return (
        F.when(d <= 0.5, 100.0).when(d <= 2, 85 + (2 - d) * 10).when(d <= 7, 55 + (7 - d) / 5 * 30).when(d <= 14, 25 + (14 - d) / 7 * 30).when(d <= 30, 5 + (30 - d) / 16 * 20).when(d <= 60, (60 - d) / 30 * 5).otherwise(0.0)
    )


def agent_stability(c: Column, trend: Column) -> Column:
    """From the variation in percent; null for one price."""
    base = F.when(c <= 10, 90 + (10 - c)).when(c <= 15, 70 + (15 - c) / 5 * 20).when(c <= 25, 40 + (25 - c) / 10 * 30).when(c <= 40, 10 + (40 - c) / 15 * 30).otherwise(F.greatest(F.lit(0.0), 10 - (c - 40) / 5))
    base = F.coalesce(F.when(c.isNotNull(), base), F.lit(50.0))
    return F.when(trend == "rising", F.least(F.lit(100.0), base + 10)).when(trend == "falling", F.greatest(F.lit(0.0), base - 15)).otherwise(base)


def speed_tier(d: Column) -> Column:
    return ladder(d, [("<=", 2, "flash"), ("<=", 7, "fast"), ("<=", 14, "normal"), ("<=", 30, "slow")], "very_slow")


def supervisor_confidence(n: Column, ratio30: Column, cv: Column, match: Column, image: Column, margin: Column) -> Column:
    sales = 25 * ladder(n, [(">=", 3, 1.0), (">=", 2, 0.7)], 0.3)
    spread = 20 * F.greatest(F.lit(0.0), 1 - 2 * F.coalesce(cv, F.lit(0.0)))
    matched = 20 * F.least(F.lit(1.0), (match - 5) / 15)
    return sales + 20 * ratio30 + spread + matched + 5 * image + 15 * ladder(margin, [(">=", 50, 1.0), (">=", 30, 0.7)], 0.4)


def supervise(available: Column, net: Column, confidence: Column, least: Column) -> Column:
    return F.when(~available, "expired").when(net <= 0, "rejected").when(confidence < least, "low_confidence").otherwise("confirmed")


def niche_health(success: Column, listings: Column, opportunities: Column, ok_sides: Column, blocked: Column, streak: Column) -> Column:
    """0 to 100; halved after five scans without success."""
    volume = ladder(listings, [(">=", 50, 20), (">=", 20, 15), (">=", 5, 10), (">", 0, 5)], 0)
    status = F.when(ok_sides >= 2, 20).when(ok_sides == 1, 10).when(blocked, 5).otherwise(0)
    total = 40 * success + volume + F.least(F.lit(20), 4 * opportunities) + status
    return js_round(F.when(streak >= 5, total * 0.5).otherwise(total), 0).cast("long")


def settlement_fee(price: Column, platform: Column) -> Column:
    rates = F.create_map(*[F.lit(v) for k, (rate, _) in SETTLEMENT.items() for v in (k, rate)])
    fixed = F.create_map(*[F.lit(v) for k, (_, amount) in SETTLEMENT.items() for v in (k, amount)])
    return price * or_else(F.coalesce(F.try_element_at(rates, platform), F.lit(0.0)), DEFAULT_RATE) + F.coalesce(F.try_element_at(fixed, platform), F.lit(0.0))


def capital_tier(value: Column, field: int = 0) -> Column:
    """Tier number (0), or its dearest purchase (2) or wanted margin (3), by value of the portfolio."""
    return ladder(value, [(">=", t[1], t[field]) for t in reversed(TIERS)], TIERS[0][field])


def strategist_score(margin: Column, target: Column, liquidity: Column, price: Column, most: Column, profit: Column, bonus: Column, available: Column) -> Column:
    m = F.when(margin >= 80, 40).when(margin >= target, 30).when(margin >= 15, 15).otherwise(5)
    liq = F.when(liquidity.isNull(), 0).otherwise(ladder(liquidity, [(">=", 80, 10), (">=", 60, 7), (">=", 40, 3)], -5))
    ratio = ladder(price / most, [("<=", 0.3, 20), ("<=", 0.6, 15), ("<=", 0.8, 10)], 5)
    won = ladder(profit, [(">=", 20, 20), (">=", 10, 15), (">=", 5, 10)], 5)
    share = price / available
    risk = F.when(share > 0.8, -25).when(share > 0.5, -10).otherwise(0)
    return m + liq + ratio + won + F.when(bonus, 10).otherwise(0) + risk


def border_colour(r: Column, g: Column, b: Column) -> Column:
    """Colour name of a border's mean; the thresholds are fixed values, the first rule wins. Shares are in hundredths, so whole channels are compared exactly."""
    total, spread = r + g + b, F.greatest(r, g, b) - F.least(r, g, b)
    rules = [
        ("black", total < 3 * 45),
        ("silver", (total > 3 * 185) & (spread < 35)),
        ("gold", (r > 140) & (g > 110) & (b < 95) & (spread > 55) & (r * 100 >= g * 92)),
        ("red", (r > 120) & (r * 100 > g * 150) & (r * 100 > b * 140)),
        ("blue", (b > 100) & (b * 100 > r * 125) & (b >= g)),
        ("green", (g > 100) & (g * 100 > r * 120) & (g * 100 > b * 115)),
        ("purple", (r > 70) & (b > 70) & (g * 100 < r * 75) & (g * 100 < b * 75) & (spread > 30)),
    ]
    return F.coalesce(*[F.when(test, name) for name, test in rules], F.lit("other"))


#: Weights of hash, border, number, print run and grid.
IMAGE_WEIGHTS = (0.20, 0.25, 0.30, 0.10, 0.15)


def image_match(phash: Column, border: tuple[Column, Column], number: tuple[Column, Column], run: tuple[Column, Column], grid: Column) -> Column:
    """Weighted likeness of two pictures over what is known of both, capped where border or number differ."""
    known = lambda x: x.isNotNull() & (x != "")
    sides = lambda p: F.when(known(p[0]) & known(p[1]), F.when(p[0] == p[1], 1.0).otherwise(0.0)).otherwise(0.5)
    no_other = tuple(F.when(x != "other", x) for x in border)
    parts = [phash, sides(no_other), F.when(known(number[0]) | known(number[1]), sides(number)), F.when(known(run[0]) | known(run[1]), sides(run)), grid]
    weight = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in zip(parts, IMAGE_WEIGHTS, strict=True)), F.lit(0.0))
    score = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in zip(parts, IMAGE_WEIGHTS, strict=True)), F.lit(0.0)) / weight
    score = F.when(F.coalesce(no_other[0] != no_other[1], F.lit(False)), F.least(score, F.lit(0.35))).otherwise(score)
    return F.when(sides(number) == 0.0, F.least(score, F.lit(0.20))).otherwise(score)


def image_label(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 0.78, "high").when(score >= 0.64, "medium").otherwise("low")


def platform_score(accessible: Column, anti_bot: Column, response_ms: Column, difficulty: Column, priority: Column) -> Column:
    """What speaks for looking for items on a platform, 100 at most. Nulls count for nothing."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = (
        points(accessible, 30) + points(~anti_bot, 25) + points((response_ms > 0) & (response_ms < 5000), 15)
        + F.when(difficulty == "easy", 20).when(difficulty == "medium", 10).otherwise(0) + F.when(priority == "high", 10).when(priority == "medium", 5).otherwise(0)
    )
    return F.least(F.lit(100), score)
