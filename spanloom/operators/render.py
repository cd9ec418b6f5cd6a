"""Rendering: spans replaced by what a tier may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import checks, keyed, spoken
from spanloom.functions import values as V
from spanloom.functions.keyed import let

REDACTED = "[REDACTED]"
DIGIT_TYPES = ["NRIC", "PASSPORT", "PHONE", "ACCOUNT_NO", "IBAN", "CARD_NO", "TXN_REF", "OTP", "PIN", "CVV", "CARD_EXPIRY", "AMOUNT"]


def match_case(original: Column, replacement: Column) -> Column:
    """Lower case if the original is."""
    return F.when(original == F.lower(original), F.lower(replacement)).otherwise(replacement)


def amount_value(surface: Column) -> Column:
    """The amount that a written money expression names, or null."""
    number = F.regexp_replace(F.regexp_extract(surface, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(surface, r"(?i)(?:\b|[0-9])(k|thousand|million|mil)\b", 1))
    return number * F.when(unit.isin("k", "thousand"), 1e3).when(unit.isin("million", "mil"), 1e6).otherwise(1.0)


def amount_band(value: Column) -> Column:
    """The band of an amount; one edge is the triage threshold."""
    edges = sorted({0, 1_000, V.TRANSFER_THRESHOLD, 10_000, 100_000, 1_000_000})
    out = F.when(value.isNull(), F.lit("[AMOUNT]"))
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when(value < high, F.lit(f"between {low:,} and {high:,} dollars"))
    return out.otherwise("over a million dollars")


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    entries = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def generalize(type_: Column, surface: Column, normal: Column | None = None) -> Column:
    """A coarser value of the same kind; ``normal`` is the written form, from which amounts are read."""
    low = F.lower(surface)
    month = F.coalesce(*[F.when(F.contains(low, F.lit(m[:3].lower())), F.lit(m)) for m in V.MONTHS])
    year = F.nullif(F.regexp_extract(surface, "[0-9]{4}", 0), F.lit(""))
    letters = F.regexp_replace(low, "[^a-z0-9]", "")
    sector = F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())) | F.contains(F.lit(n.lower()), low), F.lit(s)) for n, s in V.EMPLOYERS.items()], F.lit("a company"))
    coarse = {
        "AMOUNT": match_case(surface, amount_band(amount_value(surface if normal is None else normal))), "EMPLOYER": sector, "OCCUPATION": _lookup(low, V.OCCUPATIONS, "a professional"),
        "NATIONALITY": match_case(surface, _lookup(low, {"singaporean": "local"}, "foreign")), "SWIFT": _lookup(F.substring(letters, 5, 2), {"sg": "a local bank"}, "a foreign bank"),
        "DOB": match_case(surface, F.coalesce(year, month, F.lit("[DATE]"))), "DATE": match_case(surface, F.coalesce(month, F.lit("[DATE]"))),
    } | dict.fromkeys(("LOCATION", "BRANCH"), match_case(surface, _lookup(low, V.TOWNS | V.PLACES, "Singapore")))
    return F.coalesce(*[F.when(type_ == t, value) for t, value in coarse.items()], F.concat(F.lit("["), type_, F.lit("]")))


def digit_surrogate(surface: Column, mac: Column, keep_first: Column) -> Column:
    """The same shape with other digits, drawn from a MAC; spoken digit words of every language become digit words.

    Digits spoken in any language the detector knows are replaced too, so nothing of the number stays readable.
    """
    pattern = F.regexp_extract_all(surface, F.lit(r"(?i)[0-9]|\b(?:" + "|".join(sorted([*spoken.DIGITS, *V.HOMOPHONES], key=len, reverse=True)) + r")\b|[\s\S]"), F.lit(0))
    is_unit = lambda t: F.lower(t).isin(*"0123456789", *spoken.DIGITS, *V.HOMOPHONES)
    words = F.array(*[F.lit(w) for w in V.DIGIT_WORDS])

    def drawn(known: Column) -> Column:
        draw = lambda i: F.pmod(keyed.keyed_int(known["mac"], F.pmod(i * 5, F.lit(57))) + i, F.lit(10))
        fresh = lambda t, i: F.when(t.rlike("^[0-9]$"), draw(i).cast("string")).otherwise(match_case(t, F.get(words, draw(i).cast("int"))))
        stays = lambda x, i: ~x["unit"] | (known["keep"] & (i == known["first"]))
        return F.array_join(F.transform(known["tokens"], lambda x, i: F.when(stays(x, i), x["t"]).otherwise(fresh(x["t"], i))), "")

    marked = F.transform(pattern, lambda t: F.struct(t.alias("t"), is_unit(t).alias("unit")))
    known = lambda m: F.struct(m.alias("tokens"), mac.alias("mac"), keep_first.alias("keep"), (F.array_position(m["unit"], F.lit(True)) - 1).alias("first"))
    return keyed.let(marked, lambda m: keyed.let(known(m), drawn))


def valid_surrogate(surface: Column, mac: Column, type_: Column) -> Column:
    """A digit surrogate with its check letter or check digits put right again."""

    def checked(out: Column) -> Column:
        upper = F.upper(F.substring(out, 1, 8))
        nric = F.concat(upper, checks.nric_letter(upper))
        compact = F.regexp_replace(out, r"\s", "")
        iban = F.concat(F.substring(out, 1, 2), checks.iban_check(F.substring(compact, 1, 2), F.substring(compact, 5, 40)), out.substr(F.lit(5), F.length(out)))
        return (
            F.when((type_ == "NRIC") & out.rlike("(?i)^[STFG][0-9]{7}[A-Z]$"), match_case(surface, nric))
            .when((type_ == "IBAN") & compact.rlike("(?i)^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), iban)
            .otherwise(out)
        )

    return keyed.let(digit_surrogate(surface, mac, type_ == "PHONE"), checked)


def surrogate(type_: Column, surface: Column, mac: Column) -> Column:
    """A realistic value of the same kind, fixed by the MAC."""
    number = lambda k: keyed.keyed_int(mac, k)
    surname, given = keyed.pick(V.SURROGATE_SURNAMES, number(0)), keyed.pick(V.SURROGATE_GIVEN, number(7))
    words = F.greatest(F.size(F.split(F.trim(surface), r"\s+")), F.lit(1))
    name = F.array_join(F.slice(F.split(F.concat_ws(" ", surname, given), " "), F.lit(1), words), " ")
    said = surface.rlike(r"(?i)(?:^| )at [a-z0-9]+ dot ")
    mail = F.when(said, F.concat_ws(" ", F.lower(given), F.lit("dot"), F.lower(surname), F.lit("at mail dot example"))).otherwise(F.concat(F.lower(F.regexp_replace(F.concat_ws(".", given, surname), " ", ".")), F.lit("@mail.example")))
    day = F.concat_ws(" ", (number(14) % 28 + 1).cast("string"), keyed.pick(V.MONTHS, number(21)), F.when(surface.rlike("[0-9]{4}"), (number(28) % 56 + 1950).cast("string")))
    town = keyed.pick(list(V.TOWNS), number(35))
    address = F.concat(F.lit("Blk "), (number(42) % 999 + 1).cast("string"), F.lit(" "), town, F.lit(" Street "), (number(49) % 99 + 1).cast("string"))
    pools = {"LOCATION": list(V.TOWNS), "EMPLOYER": list(V.EMPLOYERS), "OCCUPATION": list(V.OCCUPATIONS), "NATIONALITY": [x.title() for x in V.LEXICONS["NATIONALITY"]],
             "HEALTH": V.LEXICONS["HEALTH"], "LEGAL": V.LEXICONS["LEGAL"], "RELIGION": [x.title() for x in V.LEXICONS["RELIGION"]], "PEP": V.LEXICONS["PEP"]}
    out = F.when(type_.isin(*DIGIT_TYPES), valid_surrogate(surface, mac, type_)).when(type_ == "PERSON", match_case(surface, name)).when(type_ == "EMAIL", match_case(surface, mail))
    out = out.when(type_.isin("DOB", "DATE"), match_case(surface, day)).when(type_ == "ADDRESS", match_case(surface, address))
    for t, pool in pools.items():
        out = out.when(type_ == t, match_case(surface, keyed.pick(pool, number(0))))
    return out.otherwise(REDACTED)


def pseudonyms(spans: DataFrame) -> DataFrame:
    """spans with pseudonym ``<TYPE_n>``: n counts distinct keys of a type within an id, in order of first mention.

    spans: (id, start, type, surface), and ``normal``, the written form of surfaces, where spoken and written mentions are
    to be one.
    """
    key = spoken.canonical_key(F.col("normal" if "normal" in spans.columns else "surface"))
    first = F.min("start").over(Window.partitionBy("id", "type", "_key"))
    rank = F.dense_rank().over(Window.partitionBy("id", "type").orderBy("_first"))
    named = spans.withColumn("_key", key).withColumn("_first", first)
    return named.withColumn("pseudonym", F.concat(F.lit("<"), "type", F.lit("_"), rank.cast("string"), F.lit(">"))).drop("_key", "_first")


def replacements(spans: DataFrame, texts: DataFrame, actions: DataFrame, secret: bytes) -> DataFrame:
    """A row per span and tier: (id, tier, start, end, type, class, action, layer, score, replacement).

    actions: (type, class, tier, action), a policy table of a few dozen rows.  Masking a value without digits falls back
    to its pseudonym.  A type that the policy doesn't know is suppressed in every tier.
    """
    cut = F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    cuts = spans.join(texts.select("id", "text"), "id").withColumn("surface", cut).withColumn("after_article", _after_article(F.col("text"), F.col("start"))).drop("text")
    own = pseudonyms(cuts.withColumn("normal", spoken.normalized("surface")))
    mac = _mac(secret, F.col("id"), F.col("type"), spoken.canonical_key(F.col("normal")))
    taken = F.struct("class", "tier", "action")
    by_type = actions.groupBy("type").agg(F.collect_list(taken).alias("acts"))
    hidden = actions.select(F.lit("UNKNOWN").alias("class"), "tier", F.lit("suppress").alias("action")).distinct().agg(F.collect_list(taken).alias("hidden"))
    met = own.withColumn("mac", mac).join(F.broadcast(by_type), "type", "left").join(F.broadcast(hidden))
    every = met.withColumn("act", F.explode(F.coalesce("acts", "hidden"))).select("*", "act.class", "act.tier", "act.action")
    masked = F.when(F.col("action") == "mask_last4", spoken.mask_units(F.col("surface")))  # once, though asked for again below
    every = every.withColumn("masked", masked).withColumn("act", F.when((F.col("action") == "mask_last4") & F.col("masked").isNull(), "pseudonym").otherwise(F.col("action")))
    value = _value(*[F.col(c) for c in ("act", "type", "surface", "normal", "masked", "mac", "after_article", "pseudonym")])
    return every.select("id", "tier", "start", "end", "type", "class", F.col("act").alias("action"), "layer", "score", value.alias("replacement"))


def _after_article(text: Column, start: Column) -> Column:
    return text.substr(F.greatest(start - 2, F.lit(1)), F.least(start, F.lit(3))).rlike(r"(?i)(?:^|[^a-z])an? $|^an? $")


def _mac(secret: bytes, id_: Column, type_: Column, key: Column) -> Column:
    return keyed.hmac_sha256(secret, F.concat_ws("|", id_.cast("string"), type_, key))


def _value(act: Column, type_: Column, surface: Column, normal: Column, masked: Column, mac: Column, after_article: Column, pseudonym: Column) -> Column:
    """What an action puts in the place of a surface."""
    coarse = generalize(type_, surface, normal)
    coarse = F.when(after_article, F.regexp_replace(coarse, "^(?:an?|the) ", "")).otherwise(coarse)
    return (
        F.when(act == "keep", surface).when(act == "suppress", REDACTED).when(act == "mask_last4", masked)
        .when(act == "surrogate", keyed.let(mac, lambda m: surrogate(type_, surface, m))).when(act == "generalize", coarse).otherwise(pseudonym)
    )


def render_calls(calls: DataFrame, actions: DataFrame, secret: bytes, tiers: list[str] = V.TIERS, keep: list[str] | None = None) -> DataFrame:
    """(id, tier, text) and columns of calls (keep): every text for every tier, by the rules of ``replacements`` and ``render``, a text staying one row.

    calls: (id, text, spans), the spans disjoint and in order, with surfaces.  actions: a policy table of a few dozen rows; a type
    or tier that it doesn't know is suppressed.
    """
    acts = actions.groupBy("type").agg(F.map_from_entries(F.collect_list(F.struct("tier", "action"))).alias("acts"))
    table = F.broadcast(acts.agg(F.map_from_entries(F.collect_list(F.struct("type", "acts"))).alias("policy")))
    more = keep or []
    own = calls.select("id", "text", "spans", *more, spoken.normalized_all(F.transform("spans", lambda x: x["surface"])).alias("normal"))
    known = lambda x, i: let(F.get("normal", i), lambda n: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), x["surface"].alias("surface"), n.alias("normal"), spoken.canonical_key(n).alias("key")))
    own = own.join(table).select("id", "text", "policy", *more, F.transform("spans", known).alias("p"))
    keys = lambda t: F.array_distinct(F.transform(F.filter("p", lambda x: x["type"] == t), lambda x: x["key"]))
    named = F.transform(F.array_distinct(F.transform("p", lambda x: x["type"])), lambda t: F.struct(t.alias("type"), keys(t).alias("keys")))  # in order of first mention
    own = own.select("*", named.alias("named"))

    def shown(tier: Column) -> Column:
        parts = F.transform("p", lambda x, i: F.concat(F.col("text").substr(before(i) + 1, x["start"] - before(i)), replacement(x, tier)))
        return F.concat(F.array_join(parts, ""), F.col("text").substr(before(F.size("p")) + 1, F.length("text")))

    def before(i: Column) -> Column:
        return F.coalesce(F.get("p", i - 1)["end"], F.lit(0))

    def replacement(x: Column, tier: Column) -> Column:
        act = F.coalesce(F.try_element_at(F.try_element_at(F.col("policy"), x["type"]), tier), F.lit("suppress"))
        return let(act, lambda a: put(a, x))

    def put(act: Column, x: Column) -> Column:
        others = lambda: F.get(F.filter("named", lambda y: y["type"] == x["type"]), F.lit(0))["keys"]
        pseudonym = F.concat(F.lit("<"), x["type"], F.lit("_"), F.array_position(others(), x["key"]).cast("string"), F.lit(">"))
        masked = F.coalesce(spoken.mask_units(x["surface"]), pseudonym)
        return _value(act, x["type"], x["surface"], x["normal"], masked, _mac(secret, F.col("id"), x["type"], x["key"]), _after_article(F.col("text"), x["start"]), pseudonym)

    every = F.transform(F.array(*[F.lit(t) for t in tiers]), lambda t: F.struct(t.alias("tier"), shown(t).alias("text")))
    return own.select("id", *more, F.explode(every).alias("x")).select("id", *more, "x.tier", "x.text")


def _by_tier(texts: DataFrame, replaced: DataFrame, tiers: list[str], fields: list[str]) -> DataFrame:
    """(id, tier, text, p, ends): every text for every tier, with its replacements in order and where each gap begins.

    Texts and replacements meet once; the tiers are made of one row.
    """
    every = replaced.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tier", *fields))).alias("every"))
    rows = texts.select("id", "text").join(every, "id", "left").withColumn("tier", F.explode(F.array(*[F.lit(t) for t in tiers])))
    own = F.filter(F.coalesce("every", F.array().cast(every.schema["every"].dataType)), lambda x: x["tier"] == F.col("tier"))
    return rows.select("id", "tier", "text", own.alias("p")).withColumn("ends", F.concat(F.array(F.lit(0)), F.col("p.end")))


def render(texts: DataFrame, replaced: DataFrame, tiers: list[str] = V.TIERS) -> DataFrame:
    """(id, tier, text): every text for every tier, its spans (disjoint) replaced.

    Texts without spans are shown as they are; a null text stays null.
    """
    rows = _by_tier(texts, replaced, tiers, ["start", "end", "replacement"])
    parts = F.transform("p", lambda x, i: F.concat(F.col("text").substr(F.get("ends", i) + 1, x["start"] - F.get("ends", i)), x["replacement"]))
    tail = F.col("text").substr(F.element_at("ends", -1) + 1, F.length("text"))
    return rows.select("id", "tier", F.concat(F.array_join(parts, ""), tail).alias("text"))


def rendered_turns(rendered: DataFrame) -> DataFrame:
    """(id, tier, turn, text): the turns of rendered calls."""
    return rendered.select("id", "tier", F.posexplode(F.split("text", "\n", -1)).alias("turn", "text"))


def rendered_pieces(texts: DataFrame, replaced: DataFrame, tiers: list[str] = V.TIERS) -> DataFrame:
    """(id, tier, pieces): every text as an array of struct(text, entity), in order, for every tier.

    A piece is a gap between spans, whose entity is null, or a replacement, whose entity is struct(type, class, action,
    layer, score).  No piece has the value that was replaced.
    """
    entity = F.struct("type", "class", "action", "layer", "score")
    rows = _by_tier(texts, replaced.withColumn("entity", entity), tiers, ["start", "end", "replacement", "entity"])
    none = F.lit(None).cast(replaced.select(entity.alias("entity")).schema["entity"].dataType)
    piece = lambda text, of: F.struct(text.alias("text"), of.alias("entity"))
    both = F.flatten(F.transform("p", lambda x, i: F.array(piece(F.col("text").substr(F.get("ends", i) + 1, x["start"] - F.get("ends", i)), none), piece(x["replacement"], x["entity"]))))
    tail = F.array(piece(F.col("text").substr(F.element_at("ends", -1) + 1, F.length("text")), none))
    return rows.select("id", "tier", F.filter(F.concat(both, tail), lambda x: x["text"] != "").alias("pieces"))


def action_shares(replaced: DataFrame) -> DataFrame:
    """(tier, action, n, share): how often each action is taken for a tier."""
    counts = replaced.groupBy("tier", "action").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tier")), 4))
