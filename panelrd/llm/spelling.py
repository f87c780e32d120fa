"""Spelling variant grouping through a variable-length gram index.

Words are padded on both sides and read as windows of `longest` characters, one from each place.  The prefixes of all
windows form a trie; it is pruned by frequency: a gram of more than `frequent` places is replaced by its extensions, one
character longer, others are leaves.  The leaves are the dictionary.  No gram of it is a prefix of another and every window
has room, so the gram from a place is found by reading its own characters alone: an edit changes only the grams
that hold the edited place.  The largest number of grams over one place of a word bounds what an edit can do to it (its
affected-gram bound b), so two words one edit apart have all but b of either's grams in common, each at the same place
or shifted by the edit.  Hence the lists of a word's b + 1 rarest grams are merged, and no others: two near words share one of
them.  Pairs found on these lists are verified by their edit distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelrd.llm.common import written

#: Letters of words, A-Z and a-z and U+00C0 to U+00FF; least code points and occurrences of a word.
LETTERS, LEAST_LETTERS, LEAST_COUNT = "A-Za-zÀ-ÿ", 6, 5
#: Shortest and longest grams; places beyond which a gram is extended.
SHORTEST, LONGEST, FREQUENT = 2, 6, 256
#: A form is so many times as frequent as its variants; one occurrence in so many loses a letter.
TIMES, LOSS = 5, 199
#: All tables here grow with the words.  Spark takes a written table for as large as its compressed files, and may send one to
#: every executor by way of the driver that is ten times that: they are joined by shuffles instead.
SHUFFLED = "merge"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _with_loss(run: Column, doc_id: Column) -> Column:
    """The lower-cased run, less one code point where LOSS divides the checksum of id and run."""
    checksum = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (checksum % F.char_length(run)).cast("int")
    return F.when(checksum % LOSS == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of (doc_id, text) that are long and frequent enough; counted where they stand, then summed."""
    line = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    run = line.select("id", F.explode(F.regexp_extract_all("line", F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("run"))
    run = run.select(_with_loss(F.translate("run", _UPPER, _LOWER), F.col("id")).alias("word"))
    return run.filter(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def gram_index(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """(word, n, size, grams, bound) for `words` (word, n): grams are (f, gram, p), rarest first, bound is the affected-gram bound."""
    pad = longest - 1
    padded = F.concat(F.lit("^" * pad), F.col("word"), F.lit("$" * pad))
    place = words.select("word", "n", padded.alias("padded"), F.explode(F.sequence(F.lit(1), F.char_length("word") + pad)).alias("p"))
    place = place.select("word", "n", "p", F.substr("padded", F.col("p"), F.lit(longest)).alias("window"))
    windows = written(place.groupBy("window").agg(F.count("*").alias("c")), "spelling-windows")
    prefix = windows.select("window", "c", F.explode(F.sequence(F.lit(shortest), F.lit(longest - 1))).alias("q")).withColumn("prefix", F.substr("window", F.lit(1), F.col("q")))
    inner = written(prefix.groupBy("prefix").agg(F.sum("c").alias("places")).filter(F.col("places") > frequent).select("prefix"), "spelling-inner")
    deepest = prefix.join(inner.hint(SHUFFLED), "prefix", "left_semi").groupBy("window").agg(F.max("q").alias("q"))
    leaf = windows.join(deepest.hint(SHUFFLED), "window", "left").select("window", "c", F.substr("window", F.lit(1), F.coalesce(F.col("q") + 1, F.lit(shortest))).alias("gram"))
    leaf = written(leaf, "spelling-leaves")
    lists = leaf.groupBy("gram").agg(F.sum("c").alias("f"))
    known = leaf.select("window", "gram").join(lists.hint(SHUFFLED), "gram")
    grams = place.join(known.hint(SHUFFLED), "window").groupBy("word").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("p", "f", "gram"))).alias("at"))

    def over(state: Column, g: Column) -> Column:
        """The most grams over a letter so far, and the last places of the grams that are not over at this one."""
        still = F.filter(state["ends"], lambda e: e >= g["p"])
        most = F.when(g["p"] >= longest, F.greatest(state["most"], F.size(still) + 1)).otherwise(state["most"])
        return F.struct(most.alias("most"), F.concat(still, F.array(g["p"] + F.char_length(g["gram"]) - 1)).alias("ends"))

    bound = F.aggregate("at", F.struct(F.lit(0).alias("most"), F.array().cast("array<int>").alias("ends")), over, lambda state: state["most"])
    rare = F.sort_array(F.transform("at", lambda g: F.struct(g["f"].alias("f"), g["gram"].alias("gram"), g["p"].alias("p"))))
    return grams.select("word", "n", F.char_length("word").alias("size"), rare.alias("grams"), bound.alias("bound"))


def near_words(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of `words` (word, n) one edit apart, once each, the shorter or else smaller word first."""
    index = gram_index(words, shortest, longest, frequent)
    merged = index.select("word", "n", "size", F.explode(F.slice("grams", F.lit(1), F.col("bound") + 1)).alias("g"))
    merged = written(merged.select("word", "n", "size", F.col("g.gram").alias("gram"), F.col("g.p").alias("p")), "spelling-lists")
    # the same place in a word as long or one longer, or the next place in a longer one
    ways = F.array(*(F.struct((F.col("p") + dp).alias("p"), (F.col("size") + ds).alias("size")) for dp, ds in ((0, 0), (0, 1), (1, 1))))
    a = merged.select("gram", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("size").alias("size_a"), F.explode(ways).alias("at")).select("gram", "a", "n_a", "size_a", "at.p", "at.size")
    b = merged.select("gram", "p", "size", F.col("word").alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b.hint(SHUFFLED), ["gram", "p", "size"]).filter(((F.col("size") > F.col("size_a")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root) for `forms` (word, form): the last of each chain of forms.

    A form is at least TIMES as frequent as its word, so chains have at most log(largest) / log(TIMES) steps; each round doubles
    the steps taken.
    """
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    steps = max(1, math.ceil(math.log(max(largest, 1)) / math.log(TIMES)) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = written(found.join(onward.hint(SHUFFLED), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return found


def group_variants(docs: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """The words of (doc_id, text) with their near words, forms and roots: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each; ties go to the smallest
    form in code-point order; an empty table gives no rows; other columns are not read.  Texts are read line by line.
    """
    words = written(word_counts(docs), "spelling-words")
    pairs = written(near_words(words, shortest, longest, frequent), "spelling-pairs")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    found = words.join(best.hint(SHUFFLED), "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    found = written(found, "spelling-forms")
    largest = words.agg(F.max("n")).first()[0] or 0
    chains = roots(found.filter("form IS NOT NULL").select("word", "form"), largest)
    return found.join(chains.hint(SHUFFLED), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(docs: DataFrame) -> DataFrame:
    return group_variants(docs)


#: The checksum is computed bit by bit (polynomial 0xEDB88320, reflected), words meet through the strings that lack one letter.
OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{_UPPER}', '{_LOWER}') AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL
), hexed AS (
  SELECT *, hex(encode(id || ':' || run)) AS h FROM counted
), bits AS (
  SELECT id, run, k, list_transform(range(4 * length(h)), lambda i: ((strpos('0123456789ABCDEF', substr(h, i // 8 * 2 + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END, 1)) - 1) >> (i % 4)) & 1) AS b
  FROM hexed
), summed AS (
  SELECT id, run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)), lambda c, x: xor(c >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) AS crc
  FROM bits
), lost AS (
  SELECT k, CASE WHEN crc % {LOSS} = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM summed
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM lost WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
), lacking AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM lacking a JOIN lacking b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM lacking a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM lacking a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, CASE WHEN form_n >= {TIMES} * w.n THEN form END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root FROM forms
  UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root AND f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root AND f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""
