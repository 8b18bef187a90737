"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Marked text.  A capitalised word inside a sentence is a name, and so is one that begins a sentence or stands behind a quote, bracket or line end, unless it is common there: a
COMMON-th of such words in all documents or more, so COMMON words at most, and no rarer as an ordinary token.  Digits (with inner separators) and number words are numbers; a unit word after a
number is a unit.  Each gets a mark before its lower-case value, and everything that is no letter, digit or mark
becomes a space.  The template is the marked text with the values cut off, so questions with other numbers and names share it.

Search.  The documents' templates are cut into tiles of WIDTH tokens side by side, a WIDTH-th of all windows; of the items, every
window is taken.  A shared passage of 2 WIDTH - 1 tokens holds a whole tile wherever it begins.  Windows with fewer than
PLAIN ordinary tokens say too little and are left out.  Tiles are joined with windows by hash; the benchmark side is
broadcast only if its counted windows are at most BROADCAST_ROWS.  Runs of an item that would leak it but that some place of
the tiles leaves without a tile (those of short items, and those with many placeholders) are searched whole, among all the documents' windows
of their size.  Each hit gives an alignment of an item in a document; along it, the
templates are compared token by token.  The item is leaked if RUN tokens in a row agree (or all but one of a
shorter item's; all of one with fewer than WIDTH), at least PLAIN of them ordinary, and the slots are consistent: one value of the item is never two values in the document.

Plan.  One pass over the documents marks them and writes the marked text to the shared folder (regular expressions, no Python).  Common words are counted there, and tiles and hits are
made from it; hits are few, and join it by (doc_id, hash of text), which Spark broadcasts or shuffles by measured size.

Cases.  A null or empty text has no tiles and is clean.  Items with null text or fewer than PLAIN ordinary tokens are never matched.  Items with equal text are all reported.  Rows that
repeat get equal results and are all kept.  Extra columns are ignored whatever their names.  Empty tables: no rows, or all clean; without documents no word is common.
Long texts are searched whole.  Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

WIDTH, PLAIN, RUN, COMMON = 6, 3, 13, 1000
BROADCAST_ROWS = 200_000

#: Marks of names, numbers, units, and of capitalised words that may be names (private use code points).
NAME, NUMBER, UNIT, MAYBE = "\ue000", "\ue001", "\ue002", "\ue003"

# Unit words.
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yd yards meter meters metre metres l ml litre litres liter liters gallon gallons s sec seconds second min minute minutes h hr hour hours day days week weeks month months year years eur usd dollar dollars euro euros cent cents percent mph kmh w kw v a hz khz mhz ghz kb mb gb tb".split()

# Number words.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()

# (pattern, replacement) steps before and after lower case; group references are numbers.  A name follows a letter, digit, comma, semicolon or
# bracket and a space; other capitalised words may be names.  Patterns begin with what is rare and look around from there; SQL's engine, which cannot look around, takes
# steps that consume what they see, twice where one match hides the next.
BEFORE = [(r" (?=\p{Lu})(?<=[\p{L}\p{N},;)] )", f" {NAME}"), (rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}{NAME}].)", MAYBE, 0)]
BEFORE_SQL = [*[(rf"([\p{{L}}\p{{N}},;){NAME}] )(\p{{Lu}})", 1, NAME, 2)] * 2, (rf"([^\p{{L}}\p{{N}}{NAME}])(\p{{Lu}})", 1, MAYBE, 2)]
_WORDED = f"({'|'.join(NUMBER_WORDS)})"
_INITIALS = "".join(sorted({w[0] for w in NUMBER_WORDS}))
_OTHER = rf"[^a-z0-9\p{{L}}\p{{N}}{NAME}-{MAYBE}]"
_MEASURED = (rf"{NUMBER}([^ ]* )({'|'.join(UNITS)})( )", NUMBER, 1, UNIT, 2, 3)
#: What is no token becomes a space, but for separators inside numbers; then digits and number words are numbers, and units after them units.
AFTER = [(rf"(?:(?![.,:/](?=[0-9])(?<=[0-9].)){_OTHER})+", " "), (r"([0-9][0-9.,:/]*) ?", NUMBER, 1, " "), (f" {MAYBE}?(?=[{_INITIALS}]){_WORDED}(?= )", " ", NUMBER, 1), _MEASURED]
_HELD = "\ue005"  # in SQL, a separator inside a number
AFTER_SQL = [*[(r"([0-9])([.,:/])([0-9])", 1, _HELD, 2, 3)] * 2, (rf"([^{_HELD}])[.,:/]+", 1, " "), (rf"[^a-z0-9\p{{L}}\p{{N}}{NAME}-{MAYBE}{_HELD}.,:/]+", " "), (_HELD, ""), (" +", " "), (r"([0-9][0-9.,:/]*) ?", NUMBER, 1, " "), *[(f" {MAYBE}?{_WORDED}( )", " ", NUMBER, 1, 2)] * 2, _MEASURED]
TO_TEMPLATE = (rf"([{NAME}-{UNIT}])[^ ]*", 1)


def _replace(text: Column, step: tuple) -> Column:
    return F.regexp_replace(text, step[0], "".join(f"${x}" if isinstance(x, int) else x for x in step[1:]))


def drafted(text: Column) -> Column:
    """Tokens between single spaces, with a space at either end; capitalised words that may be names still have a mark of their own."""
    x = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    for step in BEFORE:
        x = _replace(x, step)
    x = F.lower(x)
    for step in AFTER:
        x = _replace(x, step)
    return x


def marked(draft: Column, common: list[str]) -> Column:
    """Capitalised words that are not common are names, the others ordinary."""
    if common:
        draft = _replace(draft, (f"{MAYBE}({'|'.join(common)})(?= )", 1))
    return F.translate(draft, MAYBE, NAME)


def template(draft: Column, common: list[str]) -> Column:
    """What is marked, without its values."""
    one = f"{MAYBE}({'|'.join(common)})(?= )|" if common else "(\\z.)|"
    return F.translate(_replace(draft, (rf"(?=[{NAME}-{MAYBE}])(?:{one}([{NAME}-{MAYBE}])[^ ]*)", 1, 2)), MAYBE, NAME)


def common_words(drafts: DataFrame) -> list[str]:
    """drafts: m.  Of the words that may be names, those that are a COMMON-th of their occurrences or more (so COMMON at most) and that ordinary tokens are as often, in order."""
    words = drafts.select(F.explode(F.regexp_extract_all("m", F.lit(f"{MAYBE}([^ ]+)"), F.lit(1))).alias("w"))
    counts = cut(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "capitalised")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = {r["w"]: r["n"] for r in counts.where(F.col("n") * COMMON >= total).collect()}  # at most COMMON rows
    if not often:
        return []
    plain = drafts.select(F.explode(F.split("m", " ")).alias("w")).where(F.col("w").isin(list(often))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["w"] for r in plain.collect() if r["n"] >= often[r["w"]])


def tokens(x: Column) -> Column:
    return F.split(F.trim(x), " ")


def telling(window: Column, size: Column | int = WIDTH) -> Column:
    """Whether a window of so many tokens has PLAIN tokens besides placeholders: it is longer than they and the spaces explain."""
    marks = F.length(window) - F.length(F.translate(window, NAME + NUMBER + UNIT, ""))
    return size - marks >= PLAIN


def needed(n: Column) -> Column:
    """How many tokens in a row leak an item of n."""
    return F.when(n < WIDTH, n).otherwise(F.least(F.lit(RUN), n - 1))


def tiles(texts: DataFrame) -> DataFrame:
    """texts: did, h (the hash of the text) and t (template).  did, h, at (a token's place), w (the hash of the tile that begins there)."""
    own = texts.select("did", "h", tokens(F.col("t")).alias("t")).where(F.size("t") >= WIDTH)
    tile = F.transform(F.sequence(F.lit(0), (F.size("t") / WIDTH).cast("int") - 1), lambda i: F.xxhash64(F.slice("t", i * WIDTH + 1, WIDTH)))
    return own.select("did", "h", F.posexplode(tile).alias("i", "w")).select("did", "h", (F.col("i") * WIDTH).alias("at"), "w")


def windows(items: DataFrame) -> DataFrame:
    """items: item_id and t (template).  item_id and one row for each telling window: its place and hash."""
    own = items.select("item_id", tokens(F.col("t")).alias("tt")).where(F.size("tt") >= WIDTH)
    each = F.transform(F.sequence(F.lit(0), F.size("tt") - WIDTH), lambda i: F.slice("tt", i + 1, WIDTH))
    return own.select("item_id", F.posexplode(each).alias("ip", "s")).where(telling(F.array_join("s", " "))).select("item_id", "ip", F.xxhash64("s").alias("w"))


def untiled(items: DataFrame) -> DataFrame:
    """item_id, ip, r, w: the runs of r tokens that leak an item but hold no telling window at some place of the tiles."""
    own = items.select("item_id", tokens(F.col("t")).alias("tt")).withColumn("n", F.size("tt")).withColumn("r", needed(F.col("n")))
    told = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - WIDTH, F.lit(0))), lambda i: telling(F.array_join(F.slice("tt", i + 1, WIDTH), " ")))
    own = own.where(F.col("r") >= PLAIN).select("item_id", "tt", "r", told.alias("told"), F.explode(F.sequence(F.lit(0), F.col("n") - F.col("r"))).alias("ip"))
    # The tiles of a document meet a run at one of WIDTH places.
    places = F.filter(F.sequence(F.col("ip"), F.col("ip") + F.greatest(F.col("r") - WIDTH, F.lit(0))), lambda i: F.get("told", i))
    own = own.withColumn("safe", (F.col("r") >= WIDTH) & (F.size(F.array_distinct(F.transform(places, lambda i: i % WIDTH))) == WIDTH)).where("not safe")
    own = own.withColumn("s", F.slice("tt", F.col("ip") + 1, F.col("r")))
    return own.where(telling(F.array_join("s", " "), F.col("r"))).select("item_id", "ip", "r", F.xxhash64("s").alias("w"))


def met_untiled(texts: DataFrame, items: DataFrame) -> DataFrame | None:
    """did, h, item_id, shift: where a document holds a run of untiled(), whatever its place."""
    runs = untiled(items)
    sizes = {r["r"]: r["n"] for r in runs.groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most RUN rows
    if not sizes:
        return None
    runs = F.broadcast(runs) if sum(sizes.values()) <= BROADCAST_ROWS else runs
    own = texts.select("did", "h", tokens(F.col("t")).alias("t"))
    own = own.withColumn("r", F.explode(F.array(*[F.lit(r) for r in sorted(sizes)]))).where(F.size("t") >= F.col("r"))
    each = F.transform(F.sequence(F.lit(0), F.size("t") - F.col("r")), lambda i: F.xxhash64(F.slice("t", i + 1, F.col("r"))))
    return own.select("did", "h", "r", F.posexplode(each).alias("at", "w")).join(runs, ["r", "w"]).select("did", "h", "item_id", (F.col("at") - F.col("ip")).alias("shift"))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """did, h, item_id, run, n_tokens (of the item), n_changed: the leaked items of each text, by their best alignment."""
    drafts = cut(docs.select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("h"), drafted(F.col("text")).alias("m")), "marked")
    common = common_words(drafts)
    both = [marked(F.col("m"), common).alias("m"), template(F.col("m"), common).alias("t")]
    texts = drafts.select("did", "h", *both)
    items = items.select("item_id", drafted(F.col("text")).alias("m")).select("item_id", *both)
    small = windows(items)
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    met = tiles(texts).join(small, "w").select("did", "h", "item_id", (F.col("at") - F.col("ip")).alias("shift"))
    more = met_untiled(texts, items)
    met = (met if more is None else met.union(more)).distinct()
    again = drafts.select(F.col("did").alias("d2"), F.col("h").alias("h2"), "m")
    own = met.join(again, F.col("did").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")))
    own = own.select("did", "h", "item_id", "shift", *[tokens(c).alias(n) for c, n in zip(both, ("dm", "dt"), strict=True)])
    full = items.select(F.col("item_id").alias("i2"), tokens(F.col("m")).alias("mt"), tokens(F.col("t")).alias("tt"))
    pairs = own.join(full, F.col("item_id") == F.col("i2"))
    lo, hi = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("tt"), F.size("dt") - F.col("shift"))
    n = hi - lo
    aligned = pairs.select(
        "did", "h", "item_id", "shift", F.size("tt").alias("n_tokens"),
        F.explode(
            F.arrays_zip(
                F.sequence(lo, hi - 1).alias("p"),
                F.slice("tt", lo + 1, n).alias("a"),
                F.slice("dt", lo + F.col("shift") + 1, n).alias("b"),
                F.slice("mt", lo + 1, n).alias("x"),
                F.slice("dm", lo + F.col("shift") + 1, n).alias("y"),
            )
        ).alias("z"),
    ).select("did", "h", "item_id", "shift", "n_tokens", F.col("z.p").alias("p"), (F.col("z.a") == F.col("z.b")).alias("same"), F.col("z.x").alias("x"), F.col("z.y").alias("y"))
    keys = ["did", "h", "item_id", "shift", "n_tokens"]
    cells = F.array_sort(F.collect_list(F.struct("p", "same", "x", "y")))  # as many as the item has tokens
    cell = aligned.distinct().groupBy(*keys).agg(cells.alias("c"))
    # A run counts once it holds PLAIN ordinary tokens.
    ordinary = lambda c: F.when(c["x"].rlike(f"^[{NAME}-{UNIT}]"), 0).otherwise(1)
    state = lambda now, plain, most: F.struct(now.alias("now"), plain.alias("plain"), most.alias("most"))
    longer = lambda acc, now, plain: state(now, plain, F.when((plain >= PLAIN) & (now > acc["most"]), now).otherwise(acc["most"]))
    step = lambda acc, c: F.when(c["same"], longer(acc, acc["now"] + 1, acc["plain"] + ordinary(c))).otherwise(state(F.lit(0), F.lit(0), acc["most"]))
    zero = state(F.lit(0), F.lit(0), F.lit(0))
    slots = F.array_distinct(F.transform(F.filter("c", lambda c: c["same"] & c["x"].rlike(f"^[{NAME}-{UNIT}]")), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))))
    cell = cell.select(*keys, F.aggregate("c", zero, step)["most"].alias("run"), slots.alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["x"])))
    changed = F.size(F.filter("slots", lambda s: s["x"] != s["y"]))
    leaked = cell.where((F.col("run") >= needed(F.col("n_tokens"))) & consistent).select("did", "h", "item_id", "n_tokens", "run", changed.alias("n_changed"))
    best = leaked.groupBy("did", "h", "item_id", "n_tokens").agg(F.min(F.struct((-F.col("run")).alias("r"), "n_changed")).alias("b"))
    return best.select("did", "h", "item_id", "n_tokens", (-F.col("b.r")).alias("run"), F.col("b.n_changed").alias("n_changed"))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document: how many items it leaks, and the one with the longest run."""
    found = hits(docs, items).groupBy("did", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("run")).alias("r"), "item_id", "n_changed")).alias("b"))
    own = docs.select("doc_id", F.xxhash64("text").alias("h0"))
    out = own.join(found, F.col("doc_id").eqNullSafe(F.col("did")) & (F.col("h0") == F.col("h")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.col("b.item_id").alias("item_id"), (-F.col("b.r")).alias("run"), F.col("b.n_changed").alias("n_changed"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    found = hits(docs, items).select("did", "h").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["did"]) & (F.xxhash64(docs["text"]) == found["h"]), "left_anti")


def _sql_drafted(text: str) -> str:
    def step(x: str, s: tuple) -> str:
        return f"regexp_replace({x}, '{s[0]}', '{''.join(chr(92) + str(y) if isinstance(y, int) else y for y in s[1:])}', 'g')"

    x = f"' ' || coalesce({text}, '') || ' '"
    for s in BEFORE_SQL:
        x = step(x, s)
    x = f"lower({x})"
    for s in AFTER_SQL:
        x = step(x, s)
    return x


def _sql_template(x: str) -> str:
    return f"regexp_replace({x}, '{TO_TEMPLATE[0]}', '{chr(92)}1', 'g')"


_SQL_MARKED = f"translate(regexp_replace(m, p, '{chr(92)}1{chr(92)}2', 'g'), '{MAYBE}', '{NAME}')"
#: Alignments come from any three tokens that an item and a document share, at all places of both, so no tile or telling window is taken on trust.
ORACLE = f"""
WITH d0 AS MATERIALIZED (SELECT doc_id, text, {_sql_drafted('text')} AS m FROM documents),
tk AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(trim(m), ' ')) AS w FROM d0) GROUP BY w),
cp AS (SELECT w[2:] AS w, n FROM tk WHERE w[1] = '{MAYBE}' AND length(w) > 1),
pt AS (SELECT '{MAYBE}(' || coalesce(string_agg(cp.w, '|'), '{_HELD}') || ')( )' AS p FROM cp JOIN tk ON tk.w = cp.w AND tk.n >= cp.n WHERE cp.n * {COMMON} >= (SELECT sum(n) FROM cp)),
d AS MATERIALIZED (SELECT doc_id, text, trim(m) AS m, trim({_sql_template('m')}) AS t FROM (SELECT doc_id, text, {_SQL_MARKED} AS m FROM d0, pt)),
b AS MATERIALIZED (SELECT item_id, trim(m) AS m, trim({_sql_template('m')}) AS t FROM (SELECT item_id, {_SQL_MARKED} AS m FROM (SELECT item_id, {_sql_drafted('text')} AS m FROM benchmark), pt)),
dl AS MATERIALIZED (SELECT DISTINCT doc_id, text, string_split(m, ' ') AS dm, string_split(t, ' ') AS dt FROM d),
bl AS MATERIALIZED (SELECT item_id, string_split(m, ' ') AS mt, string_split(t, ' ') AS tt FROM b),
dw AS (SELECT doc_id, text, i AS at_, array_to_string(dt[i + 1 : i + {PLAIN}], ' ') AS w FROM (SELECT doc_id, text, dt, unnest(range(len(dt) - {PLAIN - 1})) AS i FROM dl)),
bw AS (SELECT item_id, i AS ip, array_to_string(tt[i + 1 : i + {PLAIN}], ' ') AS w FROM (SELECT item_id, tt, unnest(range(len(tt) - {PLAIN - 1})) AS i FROM bl)),
met AS (SELECT DISTINCT doc_id, text, item_id, at_ - ip AS shift FROM dw JOIN bw USING (w)),
al AS (SELECT m.*, l.dm, l.dt, bl.mt, bl.tt, len(bl.tt) AS n_tokens FROM met m JOIN dl l ON m.doc_id = l.doc_id AND m.text = l.text JOIN bl ON bl.item_id = m.item_id),
cells AS (SELECT doc_id, text, item_id, shift, n_tokens, p, tt[p + 1] = dt[p + shift + 1] AS same, mt[p + 1] AS x, dm[p + shift + 1] AS y
          FROM (SELECT *, unnest(range(greatest(0, -shift), least(len(tt), len(dt) - shift))) AS p FROM al)),
runs AS (SELECT doc_id, text, item_id, shift, n_tokens, max(k) AS run FROM (
           SELECT doc_id, text, item_id, shift, n_tokens, count(*) FILTER (same) AS k, count(*) FILTER (same AND NOT regexp_matches(x, '^[{NAME}-{UNIT}]')) AS plain
           FROM (SELECT *, p - sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, text, item_id, shift ORDER BY p) AS g FROM cells) GROUP BY doc_id, text, item_id, shift, n_tokens, g) WHERE plain >= {PLAIN} GROUP BY ALL),
long AS (SELECT * FROM runs WHERE run >= CASE WHEN n_tokens < {WIDTH} THEN n_tokens ELSE least({RUN}, n_tokens - 1) END),
slots AS (SELECT doc_id, text, item_id, shift, count(*) AS n, count(DISTINCT x) AS nx, count(*) FILTER (x <> y) AS n_changed
          FROM (SELECT DISTINCT doc_id, text, item_id, shift, x, y FROM cells SEMI JOIN long USING (doc_id, text, item_id, shift) WHERE same AND regexp_matches(x, '^[{NAME}-{UNIT}]')) GROUP BY ALL),
leaked AS (SELECT r.doc_id, r.text, r.item_id, r.run, coalesce(s.n_changed, 0) AS n_changed,
                  row_number() OVER (PARTITION BY r.doc_id, r.text, r.item_id ORDER BY r.run DESC, coalesce(s.n_changed, 0)) AS k
           FROM long r LEFT JOIN slots s ON r.doc_id = s.doc_id AND r.text = s.text AND r.item_id = s.item_id AND r.shift = s.shift
           WHERE coalesce(s.n = s.nx, true)),
best AS (SELECT doc_id, text, item_id, run, n_changed, count(*) OVER (PARTITION BY doc_id, text) AS n, row_number() OVER (PARTITION BY doc_id, text ORDER BY run DESC, item_id, n_changed) AS r
         FROM leaked WHERE k = 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_items, item_id, run::INTEGER AS run, n_changed::INTEGER AS n_changed
FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id AND d.text = best.text AND r = 1
"""
