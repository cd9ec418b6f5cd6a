"""Language models, classifiers, privacy accounting and linkage on token tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import keyed
from spanloom.functions.durable import durable
from spanloom.functions.offsets import running_sums
from spanloom.operators.spans import overlaps

TOKEN = r"[a-z0-9$<>_\[\]@.]+"  # a fixed value


def tokens(texts: DataFrame) -> DataFrame:
    """(id, pos, tok): lower-case tokens in order, ``<s>`` first; texts without tokens have ``<s>`` alone."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0))
    return texts.select("id", F.posexplode(F.concat(F.array(F.lit("<s>")), found)).alias("pos", "tok"))


def bigrams(texts: DataFrame) -> DataFrame:
    """(id, pos, a, b): each token of texts (id, text), ``<s>`` first, with the one after it; paired before rows are made."""
    found = F.concat(F.array(F.lit("<s>")), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0)))
    pairs = texts.select("id", found.alias("w")).select("id", F.posexplode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("pos", "x"))
    return pairs.select("id", "pos", "x.a", "x.b")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(a, b, c_ab): how often each bigram occurs."""
    return bigrams(texts).groupBy("a", "b").agg(F.count("*").alias("c_ab"))


def model(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Counts of training texts: pairs (a, b, c_ab), contexts (a, c_a), words (b, c_b), totals (n, v), a single row.

    All come from the counts of pairs, which are written to the shared folder once.
    """
    pairs = durable(pair_counts(texts), "pairs")
    words = pairs.groupBy("b").agg(F.sum("c_ab").alias("c_b"))
    return pairs, pairs.groupBy("a").agg(F.sum("c_ab").alias("c_a")), words, words.agg(F.sum("c_b").alias("n"), F.count("*").alias("v"))


def log_probabilities(asked: DataFrame, counts: tuple[DataFrame, DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """asked (a, b, ...) with logp and known: 0.7 of the bigram share and 0.3 of the smoothed word share; the latter alone after unseen contexts.

    ``asked`` is best a table of distinct pairs with their number: hot words are then one row each.
    """
    pairs, contexts, words, totals = counts
    two = asked.join(pairs.withColumnRenamed("c_ab", "_ab"), ["a", "b"], "left").join(contexts, "a", "left").join(words, "b", "left").join(F.broadcast(totals))
    one = (F.coalesce("c_b", F.lit(0)) + 1) / (F.col("n") + F.col("v"))
    mixed = 0.7 * F.coalesce("_ab", F.lit(0)) / F.col("c_a") + 0.3 * one
    return two.select(*asked.columns, F.ln(F.when(F.col("c_a").isNull(), one).otherwise(mixed)).alias("logp"), F.col("c_b").isNotNull().alias("known"))


def perplexity(logps: DataFrame) -> DataFrame:
    """(tokens, perplexity, oov) of scored pairs with their number c_ab."""
    tokens, mean = F.sum("c_ab"), F.sum(F.col("c_ab") * F.col("logp")) / F.sum("c_ab")
    unknown = F.sum(F.when(F.col("known"), 0).otherwise(F.col("c_ab"))) / F.sum("c_ab")
    return logps.agg(tokens.alias("tokens"), F.round(F.exp(-mean), 2).alias("perplexity"), F.round(unknown, 4).alias("oov"))


def span_perplexity(texts: DataFrame, spans: DataFrame, counts: tuple[DataFrame, DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(type, tokens, perplexity) of the tokens inside spans (id, start, end, type), each after the token before it.

    A token belongs to a span if it shares a character with it.
    """
    text = F.coalesce("text", F.lit(""))
    written = r"(?i)" + TOKEN  # in the text itself: lower() may change its length
    cut, found = F.split(text, written, -1), F.regexp_extract_all(text, F.lit(written), F.lit(0))
    parts = texts.select("id", F.slice(cut, F.lit(1), F.size(found)).alias("cut"), found.alias("w"))
    before = running_sums(F.zip_with("cut", "w", lambda c, w: F.length(c) + F.length(w)))
    word = lambda i: F.lower(F.get("w", i))
    each = F.transform(F.zip_with(before, "cut", lambda b, c: b + F.length(c)), lambda at, i: F.struct(F.when(i == 0, "<s>").otherwise(word(i - 1)).alias("a"), word(i).alias("b"), at.alias("start"), (at + F.length(F.get("w", i))).alias("end")))
    toks = parts.select("id", F.explode(each).alias("x")).select("id", "x.*")
    held = toks.alias("a").join(spans.alias("b"), (F.col("a.id") == F.col("b.id")) & overlaps())
    asked = held.groupBy(F.col("a.a").alias("a"), F.col("a.b").alias("b"), F.col("b.type").alias("type")).agg(F.count("*").alias("c_ab"))
    scored = log_probabilities(asked, counts)
    return scored.groupBy("type").agg(F.sum("c_ab").alias("tokens"), F.round(F.exp(-F.sum(F.col("c_ab") * F.col("logp")) / F.sum("c_ab")), 2).alias("perplexity"))


def naive_bayes(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, label): the most likely label of test (id, tok) under add-one counts of train (id, tok, label).

    The prior is the logarithm of a label's documents; ties go to the smaller label.
    """
    prior = train.select("id", "label").distinct().groupBy("label").agg(F.ln(F.count("*").cast("double")).alias("prior"))
    counts = train.groupBy("label", "tok").agg(F.count("*").alias("c"))
    size = train.groupBy("label").agg(F.count("*").alias("n"))
    vocabulary = train.agg(F.countDistinct("tok").alias("v"))
    base = prior.join(size, "label").join(F.broadcast(vocabulary))
    seen = test.join(F.broadcast(base)).join(counts, ["label", "tok"], "left")
    part = F.ln((F.coalesce("c", F.lit(0)) + 1) / (F.col("n") + F.col("v")))
    scores = seen.groupBy("id", "label").agg((F.first("prior") + F.sum(part)).alias("score"))
    return scores.groupBy("id").agg(F.min_by("label", F.struct(-F.round("score", 6), "label")).alias("label"))


def capped(toks: DataFrame, cap: int, key: bytes) -> DataFrame:
    """(id, tok): at most ``cap`` distinct tokens of each contributor, chosen by a keyed hash (the feature of this count)."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(keyed.hmac_sha256(key, F.concat_ws("|", F.col("id").cast("string"), "tok")), "tok"))
    return toks.select("id", "tok").distinct().withColumn("n", rank).where(F.col("n") <= cap).drop("n")


def word_lists(texts: DataFrame) -> DataFrame:
    """(id, toks): the lower-case tokens of texts (id, text), one array a text."""
    return texts.select("id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0)).alias("toks"))


def pair_lists(texts: DataFrame) -> DataFrame:
    """(id, toks): the bigrams of texts (id, text), ``<s>`` before the first token, each with a blank between."""
    after = lambda w, i: F.concat_ws(" ", F.when(i == 0, "<s>").otherwise(F.get("toks", i - 1)), w)
    return word_lists(texts).withColumn("toks", F.transform("toks", after))


def capped_lists(lists: DataFrame, cap: int, key: bytes) -> DataFrame:
    """What ``capped`` takes of all tokens in lists (id, toks), of which each list gives ``cap`` tokens to the shuffle at most.

    The first tokens of a contributor are among the first of each of its lists.
    """
    drawn = F.transform(F.array_distinct("toks"), lambda t: F.struct(keyed.hmac_sha256(key, F.concat_ws("|", F.col("id").cast("string"), t)).alias("mac"), t.alias("tok")))
    first = lists.select("id", F.explode(F.slice(F.array_sort(drawn), 1, cap)["tok"]).alias("tok"))
    return capped(first.repartition("id"), cap, key)


def laplace_counts(capped_rows: DataFrame, scale: float, threshold: float, key: bytes) -> DataFrame:
    """(tok, n, noisy): counts with Laplace noise from a keyed uniform; those below the threshold are left out."""
    u = (keyed.keyed_int(keyed.hmac_sha256(key, F.col("tok"))) + 0.5) / float(1 << 28) - 0.5
    noise = -F.signum(u) * scale * F.ln(1 - 2 * F.abs(u))
    noisy = capped_rows.groupBy("tok").agg(F.count("*").alias("n")).withColumn("noisy", F.round(F.col("n") + noise, 4))
    return noisy.where(F.col("noisy") >= threshold)


def plain_words(text: Column) -> Column:
    """Lower-case words of any script, one space between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w ]", " "), " +", " "))


def mentions(texts: DataFrame, people: DataFrame, attributes: list[str]) -> DataFrame:
    """(id, attribute, value): the values of people's attributes that a text names, as whole words.

    Ids and first words meet the values without the texts; only values of several words are then looked for in them.
    """
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), plain_words(F.col(a)).alias("value")) for a in attributes]))
    names = people.select(*attributes).distinct().select(each.alias("x")).select("x.*").where("value <> ''").distinct().withColumn("head", F.split_part("value", F.lit(" "), F.lit(1)))
    low = texts.select("id", plain_words(F.col("text")).alias("low"))
    heads = low.select("id", F.explode(F.array_distinct(F.split("low", " "))).alias("head"))
    maybe = heads.join(names, "head").select("id", "attribute", "value").distinct()
    long = F.contains("value", F.lit(" "))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    asked = maybe.where(long).groupBy("id").agg(F.collect_list(F.struct("attribute", "value")).alias("asked"))
    said = low.join(asked, "id").withColumn("asked", F.filter("asked", lambda x: F.contains(padded(F.col("low")), padded(x["value"]))))
    return maybe.where(~long).unionByName(said.select("id", F.explode("asked").alias("x")).select("id", "x.*")).distinct()


#: Combinations of named values that a question may be turned into; questions with more start from their rarest attribute.
COMBINATIONS = 64


def linkage(texts: DataFrame, people: DataFrame, attributes: list[str]) -> DataFrame:
    """(id, active, candidates, first): people who have, for every attribute of which a text names values, one of these.

    People with equal attributes are one group, and texts that name the same values are one question: only distinct
    questions meet distinct groups.  ``first`` is the smallest such person.  Texts without any value are left out.

    For each set of attributes that questions name, people are counted by these attributes alone, and questions join the
    counts by all their values: a value that a third of all people have costs one row.  A question of very many values
    starts from its rarest attribute instead, whose groups are then checked for the others.
    """
    asked = mentions(texts, people, attributes).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("attribute", "value"))).alias("asked"))
    asked = durable(asked, "asked")
    groups = people.groupBy(*[plain_words(F.col(a)).alias(a) for a in attributes]).agg(F.count("*").alias("n"), F.min("person").alias("first"))
    groups = durable(groups, "groups")
    of = lambda a: F.transform(F.filter("asked", lambda x: x["attribute"] == a), lambda x: x["value"])
    named = [of(a).alias(a) for a in attributes]
    questions = durable(asked.select("asked").distinct().select("asked", *named), "questions")
    sizes = [F.greatest(F.size(a), F.lit(1)).cast("double") for a in attributes]
    every = reduce(lambda a, b: a * b, sizes)
    found = []
    kinds = questions.where(every <= COMBINATIONS).select(*[(F.size(a) > 0).alias(a) for a in attributes]).distinct().collect()  # sets of attributes
    for kind in kinds:
        on = [a for a in attributes if kind[a]]
        own = questions.where(every <= COMBINATIONS)
        for a in attributes:
            own = own.where(F.size(a) > 0).withColumn(a, F.explode(a)) if kind[a] else own.where(F.size(a) == 0).drop(a)
        counts = groups.groupBy(*on).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        found.append(own.join(counts, on).select("asked", "n", "first"))
    wide = questions.where(every > COMBINATIONS)
    if not wide.isEmpty():
        found.append(_from_rarest(wide, groups, attributes))
    none = asked.select("asked").limit(0).select("asked", F.lit(0).cast("long").alias("n"), F.lit(None).cast(groups.schema["first"].dataType).alias("first"))
    answers = reduce(DataFrame.unionByName, found, none).groupBy("asked").agg(F.sum("n").alias("candidates"), F.min("first").alias("first"))
    active = F.size(F.array_distinct(F.transform("asked", lambda x: x["attribute"])))
    return asked.join(answers, "asked", "left").select("id", active.cast("long").alias("active"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "first")


def _from_rarest(questions: DataFrame, groups: DataFrame, attributes: list[str]) -> DataFrame:
    """(asked, n, first): groups that fit questions (asked, an array of values for each attribute), found by the rarest one.

    The rarest attribute of a question is that whose named values the fewest groups have; rows made are at most those.
    """
    value = lambda a: F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value"))
    lists = groups.select(F.explode(F.array(*[value(a) for a in attributes])).alias("x")).where("x.value is not null").groupBy("x.attribute", "x.value").agg(F.count("*").alias("size"))
    costs = questions.select("asked", F.explode("asked").alias("x")).select("asked", "x.*").join(lists, ["attribute", "value"], "left")
    costs = costs.groupBy("asked", "attribute").agg(F.sum(F.coalesce("size", F.lit(0))).alias("cost"))
    rarest = costs.groupBy("asked").agg(F.min_by("attribute", F.struct("cost", "attribute")).alias("rarest"))
    started = questions.join(rarest, "asked").withColumn("value", F.explode(F.coalesce(*[F.when(F.col("rarest") == a, F.col(a)) for a in attributes])))
    started = started.select("asked", F.col("rarest").alias("attribute"), "value", *[F.col(a).alias(f"_{a}") for a in attributes])
    listed = groups.select("*", F.explode(F.array(*[value(a) for a in attributes])).alias("x")).select("*", "x.attribute", "x.value").drop("x")
    fits = reduce(lambda a, b: a & b, [(F.size(f"_{a}") == 0) | F.coalesce(F.array_contains(f"_{a}", F.col(a)), F.lit(False)) for a in attributes])
    return started.join(listed, ["attribute", "value"]).where(fits).select("asked", "n", "first")


def linkage_with_log(texts: DataFrame, people: DataFrame, log: DataFrame, attributes: list[str], logged: list[str]) -> DataFrame:
    """(id, candidates, first): people whom the text fits and who, in the log (person, *logged), did what the text's row says.

    texts: (id, text, *logged).  People with equal attributes who did the same are one group; a person counts once.
    """
    did = log.select("person", *logged).distinct().join(people, "person")
    cell = F.to_json(F.struct(*logged))
    every = linkage(texts.withColumn("text", F.concat_ws(" ", "text", _cell_word(cell))), did.withColumn("_cell", _cell_word(cell)), [*attributes, "_cell"])
    return every.select("id", "candidates", "first")


def _cell_word(cell: Column) -> Column:
    """A log cell as one word that no text has."""
    return F.concat(F.lit("cell"), F.sha2(cell, 256))


def reidentified(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(texts, unique_and_right, truth_in_set, median_candidates) of linkage results (id, candidates, first, holds) against truth (id).

    ``holds`` tells whether the true person is among the candidates.  Texts that name nothing count, with no link; the
    median is the upper one of the candidate numbers.
    """
    every = truth.select("id").join(found, "id", "left")
    right = (F.col("candidates") == 1) & F.col("holds")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4)
    rank = Window.orderBy("candidates")
    sizes = every.where("candidates is not null").groupBy("candidates").agg(F.count("*").alias("n"))  # a row per size
    upper = sizes.withColumn("upto", F.sum("n").over(rank)).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0)))).where("upto > all div 2").agg(F.min("candidates").alias("median_candidates"))
    return every.agg(F.count("*").alias("texts"), share(right).alias("unique_and_right"), share(F.col("holds")).alias("truth_in_set")).join(F.broadcast(upper))


def direct_leaks(texts: DataFrame, values: DataFrame) -> DataFrame:
    """(id, leaks): how many of a text's own direct identifiers (id, value) it still shows, by letters and digits only."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9@]", "")
    both = values.where("value is not null").select("id", bare(F.col("value")).alias("value")).where("value <> ''").distinct().join(texts.select("id", bare(F.col("text")).alias("low")), "id")
    return both.groupBy("id").agg(F.count_if(F.contains("low", F.col("value"))).alias("leaks"))


def planted(texts: DataFrame, canaries: DataFrame, key: bytes) -> DataFrame:
    """texts (id, text) with the canaries (canary, said, times) added as last lines, each to ``times`` texts.

    A keyed hash orders the texts; the canaries take them in turn, each text one canary at most.  Canaries are a small
    table; if they ask for more texts than there are, the last ones get fewer.
    """
    upto = Window.partitionBy(F.lit(0)).orderBy("canary").rowsBetween(Window.unboundedPreceding, -1)  # a row per canary
    slots = canaries.withColumn("_first", F.coalesce(F.sum("times").over(upto), F.lit(0)))
    slots = slots.select("said", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("times") - 1)).alias("_at"))
    order = keyed.hmac_sha256(key, F.col("id").cast("string"))
    wanted = canaries.agg(F.sum("times")).first()[0] or 0
    chosen = texts.select("id", order.alias("_mac")).orderBy("_mac", "id").limit(wanted)  # as many as are planted
    chosen = chosen.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_mac", "id")) - 1)
    said = chosen.join(F.broadcast(slots), "_at").select("id", "said")
    both = texts.join(F.broadcast(said), "id", "left")
    return both.select("id", F.when(F.col("said").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "text", "said")).alias("text"))


def candidate_scores(candidates: DataFrame, counts: tuple[DataFrame, DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """candidates (canary, planted, said) with logp under a model of bigrams: the sum over the tokens of ``said``.

    Candidates share their beginnings: every edge of the trie of their tokens is one row, and has its factor once,
    whatever the number of candidates that pass it; the sums go down the trie level by level.
    """
    toks = F.concat(F.array(F.lit("<s>")), F.regexp_extract_all(F.lower("said"), F.lit(TOKEN), F.lit(0)))
    rows = durable(candidates.select("canary", "planted", "said", toks.alias("w")), "candidates")
    node = lambda k: F.xxhash64(F.slice("w", F.lit(1), k + 1), k)
    steps = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("level"), node(k - 1).alias("up"), node(k).alias("node"), F.get("w", k - 1).alias("a"), F.get("w", k).alias("b")))
    trie = rows.where(F.size("w") > 1).select(F.explode(steps).alias("x")).select("x.*").distinct()
    pairs = log_probabilities(trie.select("a", "b").distinct(), counts).select("a", "b", "logp")
    trie = durable(trie.join(pairs, ["a", "b"]).select("level", "up", "node", "logp"), "trie")
    top = trie.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]  # the longest candidate
    done = trie.where("level = 1").select("node", F.col("logp").alias("sum"))
    every = [done]
    for level in range(2, top + 1):
        done = durable(trie.where(F.col("level") == level).join(done.withColumnRenamed("node", "up"), "up").select("node", (F.col("sum") + F.col("logp")).alias("sum")), "sums")
        every.append(done)
    sums = reduce(DataFrame.unionByName, every)
    last = node(F.size("w") - 1)
    return rows.select("canary", "planted", "said", last.alias("node")).join(sums, "node", "left").select("canary", "planted", "said", F.coalesce("sum", F.lit(0.0)).alias("logp"))


def exposure(scores: DataFrame) -> DataFrame:
    """(canary, exposure): log2 of the candidates less log2 of the planted one's rank (ties count) by logp."""
    planted = scores.where("planted").select("canary", F.col("logp").alias("mine"))
    ranked = scores.join(planted, "canary").groupBy("canary").agg(F.count("*").alias("n"), F.count_if((F.col("logp") >= F.col("mine")) & ~F.col("planted")).alias("above"))
    return ranked.select("canary", F.round(F.log2("n") - F.log2(F.col("above") + 1), 4).alias("exposure"))


def rerank(hypotheses: DataFrame, weight: float) -> DataFrame:
    """(id, hyp): of each list the hypothesis of the largest lp + weight * mean LM logp (ties: the smaller text)."""
    return hypotheses.groupBy("id").agg(F.min_by("hyp", F.struct(-(F.col("lp") + weight * F.col("lm")), "hyp")).alias("hyp"))


def best_weight(hypotheses: DataFrame, weights: list[float]) -> DataFrame:
    """(weight, errors): the weight whose re-ranked hypotheses (id, hyp, lp, lm, errors) have the fewest errors; ties: the smallest."""
    every = hypotheses.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    chosen = every.groupBy("weight", "id").agg(F.min_by("errors", F.struct(-(F.col("lp") + F.col("weight") * F.col("lm")), "hyp", "errors")).alias("errors"))
    return chosen.groupBy("weight").agg(F.sum("errors").alias("errors")).orderBy("errors", "weight").limit(1)


def oracle_errors(hypotheses: DataFrame) -> DataFrame:
    """(errors): of the best hypothesis of every list (id, errors): what no re-ranking can go below."""
    return hypotheses.groupBy("id").agg(F.min("errors").alias("e")).agg(F.sum("e").alias("errors"))
