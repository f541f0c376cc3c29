"""Spelling variants by a dictionary of pairs of trie nodes.

Words lie in two tries, one read forwards and one backwards. A prefix is a node of the first, a suffix one of the second,
and both are integers. A word of n letters gives n + 1 pairs (prefix, all that follows) and, with one letter skipped, n
pairs (prefix, what follows the letter). Two words that differ in one replaced letter share a skipping pair; a word that
has one letter more than another shares a skipping pair with a whole pair of the other. No other words meet, so joins of
equal pairs give the exact neighbours, and since a pair and the skipped letter give the word, as many words meet on one
pair as there are letters, and one more.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import read_table
from tallyframe.session import release, stored

#: Fewest letters and occurrences of a word; how many times as often its form occurs.
LEAST_LETTERS, LEAST_TIMES, RATIO = 6, 5, 5
#: Occurrences that lose a letter, one in so many by their checksum.
SPOILT = 199
#: Nodes up to this depth are numbered by their letters, a byte each.
SHALLOW = 7
#: Deeper nodes are told apart by their letters up to this depth, by a digest of them beyond.
PLAIN = 64


def words_of(docs: DataFrame, spoilt: int | None = None) -> DataFrame:
    """(word, n): how often each word of LEAST_LETTERS letters or more occurs in whole texts, if LEAST_TIMES or more.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lowered. With ``spoilt``, an occurrence whose
    checksum crc32("<doc_id>:<word>") is divisible by it loses the letter at the checksum modulo the word's length; a
    missing doc_id counts as no text before the colon. Null and empty texts have no words, repeated rows count again.
    """
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # A run that is too short stays too short without a letter.
    runs = F.regexp_extract_all(lowered, F.lit(f"([a-zÀ-ÿ]{{{LEAST_LETTERS},}})"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("word"))
    word = F.col("word")
    if spoilt:
        check = F.crc32(F.concat("doc", F.lit(":"), word).cast("binary"))
        at = F.pmod(check, F.length(word)).cast("int")
        word = F.when(check % spoilt == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)
    counted = found.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_TIMES)


def _text_of(word: Column, at: Column, forward: bool) -> Column:
    """The first ``at`` letters, or the last."""
    return F.substring(word, F.lit(1), at) if forward else F.substring(word, F.length(word) - at + 1, at)


def _shallow(text: Column) -> Column:
    """The bytes of up to SHALLOW letters as a number; no letter is the byte 0, so numbers tell lengths apart."""
    return F.coalesce(F.conv(F.hex(F.encode(text, "ISO-8859-1")), 16, 10).cast("long"), F.lit(0))


def _deep_nodes(words: DataFrame, forward: bool) -> DataFrame:
    """(id, nodes): numbers, all negative, of a word's nodes by depth, from SHALLOW + 1 letters on."""
    length, depth = F.length("word"), F.col("depth")
    text = _text_of(F.col("word"), depth, forward)
    label = F.when(depth <= PLAIN, text).otherwise(F.sha2(text.cast("binary"), 256))
    deep = words.where(length > SHALLOW).select("id", "word", F.explode(F.sequence(F.lit(SHALLOW + 1), length)).alias("depth"))
    deep = deep.select("id", "depth", label.alias("label"))
    numbers = stored(
        deep.select("depth", "label").distinct().withColumn("node", -1 - F.monotonically_increasing_id()), "nodes"
    )
    placed = deep.join(numbers, ["depth", "label"])
    return placed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("depth", "node"))).alias("nodes"))


def node_pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, id, n, skips, first) for every word (id, word, n): its pairs of nodes. ``skips`` says that a letter
    is left out between them, ``first`` that it does not repeat the letter before it."""
    word, at, length = F.col("word"), F.col("at"), F.length("word")
    with_nodes = words
    for name, forward in (("forward", True), ("backward", False)):
        nodes = _deep_nodes(words, forward).select(F.col("id").alias("own"), F.col("nodes").alias(name))
        with_nodes = with_nodes.join(nodes, F.col("id") == F.col("own"), "left").drop("own")

    def number(size: Column, name: str) -> Column:
        short = _shallow(_text_of(word, size, name == "forward"))
        return F.when(size <= SHALLOW, short).otherwise(F.element_at(name, size))

    at_each = with_nodes.withColumn("at", F.explode(F.sequence(F.lit(0), length)))
    whole = F.struct(number(length - at, "backward").alias("suffix"), F.lit(False).alias("skips"), F.lit(False).alias("first"))
    repeats = (at > 0) & (F.substring(word, at, F.lit(1)) == F.substring(word, at + 1, F.lit(1)))
    skipping = F.when(
        at < length,
        F.struct(number(length - at - 1, "backward").alias("suffix"), F.lit(True).alias("skips"), (~repeats).alias("first")),
    )
    return at_each.select(
        number(at, "forward").alias("prefix"), F.explode(F.array_compact(F.array(whole, skipping))).alias("pair"), "id", "n"
    ).select("prefix", "pair.*", "id", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): for every word (id, word, n) that has near words, how many, and the most frequent of them as
    (n, -id), ties going to the smaller id. Two words are near if one inserted, deleted or replaced letter parts them.

    A replaced letter is met on one pair only. Words that differ by a letter more or less meet wherever a letter of one
    run of equal letters is skipped, and are counted at the first. Groups are bounded by the letters there are.
    """
    met = (
        node_pairs(words)
        .groupBy("prefix", "suffix")
        .agg(F.collect_list(F.struct(F.col("n"), (-F.col("id")).alias("order"), "skips", "first")).alias("members"))
        .where(F.size("members") > 1)
        .select("members", F.explode("members").alias("own"))
    )
    own = F.col("own")

    def near(other: Column) -> Column:
        both = own["skips"] & other["skips"] & (own["order"] != other["order"])
        more = own["skips"] & own["first"] & ~other["skips"]
        less = ~own["skips"] & other["skips"] & other["first"]
        return both | more | less

    others = F.transform(F.filter("members", near), lambda m: F.struct(m["n"].alias("n"), m["order"].alias("order")))
    each = met.select((-own["order"]).alias("id"), others.alias("others")).where(F.size("others") > 0)
    return each.groupBy("id").agg(F.sum(F.size("others")).alias("n_near"), F.max(F.array_max("others")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) for every word (id, form) with a form: the last form that forms lead to. A form occurs RATIO times as
    often as its word, so that chains are short and never close; each step doubles the way gone."""
    done, open_ = [], stored(forms.select("id", F.col("form").alias("root")), "roots")
    step = stored(open_, "steps")
    while True:
        ahead = step.select(F.col("id").alias("at"), F.col("root").alias("next"))
        moved = stored(open_.join(ahead, F.col("root") == F.col("at"), "left").select("id", "root", "next"), "roots")
        done.append(moved.where("next IS NULL").select("id", "root"))
        further = moved.where("next IS NOT NULL").select("id", F.col("next").alias("root"))
        if further.isEmpty():
            break
        doubled = step.join(ahead, F.col("root") == F.col("at"), "left").select("id", F.coalesce("next", "root").alias("root"))
        step = stored(doubled, "steps", replaces=[step])
        open_ = further
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def spelling_variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per row (word, n), words being distinct: word, form, root, n, n_near, form_n.

    ``form`` is the most frequent near word (ties: the first in code-point order) if it occurs at least ``ratio`` times as
    often, or else null; ``root`` follows forms to the last and is the word itself without one; ``n_near`` counts near
    words. No words give no rows.
    """
    # Numbered in code-point order; the sort is by ranges, over distinct words alone, and reads them twice.
    counted = stored(counted.select("word", "n"), "counted")
    words = stored(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words", replaces=[counted])
    near = stored(neighbours(words), "near")
    with_near = stored(
        words.join(near, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.order")).alias("form"),
        ),
        "forms",
        replaces=[near],
    )
    has_form = with_near.where("form IS NOT NULL")
    roots = _roots(has_form).withColumnRenamed("id", "own")
    named = words.select(F.col("id").alias("named"), "word", "n")
    form = named.toDF("form", "form_word", "form_n")
    root = named.select(F.col("named").alias("root"), F.col("word").alias("root_word"))
    variants = (
        has_form.join(roots, F.col("id") == F.col("own")).join(form, "form").join(root, "root")
        .select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    )
    none = with_near.where("form IS NULL").select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near",
        F.lit(None).cast("long").alias("form_n"),
    )
    return variants.unionByName(none)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, a letter being lost at one occurrence in SPOILT. Nulls, empty
    texts and repeated rows count as ``words_of`` says; an empty table gives no rows."""
    return spelling_variants(words_of(read_table(spark, sf_dir, "documents"), SPOILT))
