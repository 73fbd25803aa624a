"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units behind numbers and names (words with a capital) become typed placeholders, other words small letters
without signs. Windows of ``WINDOW`` such tokens, at least ``LITERALS`` of them words, are hashed and joined with the
windows of the benchmark. A word with a capital can be a name or not, above all where a sentence begins: an item's
window has a key for each reading of these, a document's one for all as names, for those inside sentences, and for none
(so a copy in small letters is found too). An item's window with too many numbers and units has a key of its tokens with
their values instead (``verbatim`` copies). Of a document and an item the windows met give pairs of aligned tokens; the
pair is a leak if they cover at least ``COVER`` of the item's tokens and the slots are consistent: within a type, equal
values of the item stand for equal values of the document and unequal for unequal ones. (A word that the item also has in
small letters is no name where a sentence begins.) A leak whose values all agree is ``verbatim``, any other
``reparameterised``.

Items of fewer than ``WINDOW`` tokens have one window of their own length; those of fewer than ``LITERALS`` tokens leak
only into a document that is, token by token and with equal values, the whole item (a common word marks no documents).
The benchmark's windows are broadcast only up to ``BROADCAST_ROWS`` rows, and so are the leaks found; beyond that the
joins shuffle. Windows that many items share are looked up last, see ``_hits``.

Defined cases: null or empty texts and items match nothing; ids are taken as unique, and rows that share one are searched
each but reported as one; a null id is never reported (and its row kept by ``without_leaks``); texts of any length are
read whole; other columns play no part; empty tables give no leaks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.frames import cut, fresh

WINDOW = 8
LITERALS = 4
COVER = 0.5
BROADCAST_ROWS = 500_000
#: Items of a key that are all looked up for each place of it.
HOT = 32

#: Units that are a slot behind a number.
UNITS = (
    "km m cm mm mi ft kg g mg lb lbs oz l ml s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years usd eur gbp dollar dollars euro euros pound pounds cent cents percent degree degrees mph kmh kwh kw w v hz "
    "gb mb kb tb meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres"
)
#: Signs that a token begins with if it is a number, a unit, a name inside a sentence, another word with a capital; and what a sign inside a number stands behind.
_NUMBER, _UNIT, _NAME, _CAPITAL, _INSIDE = "\x01", "\x02", "\x03", "\x04", "\x05"
_MARKS = _NUMBER + _UNIT + _NAME + _CAPITAL + _INSIDE
_NUMBERS = rf"[0-9]+(?:{_INSIDE}[.,:/-][0-9]+)*"
_NAMES = r"(?<=[\p{Ll},;] )\p{Lu}[\p{L}\p{M}]*"
_CAPITALS = rf"(?<![\p{{L}}\p{{M}}{_NAME}])\p{{Lu}}"
_OTHERS = rf"(?:(?<!{_INSIDE})[^\p{{L}}\p{{M}}0-9{_MARKS}])+"
_UNITS = rf"({_NUMBER}[^ ]+) [{_CAPITAL}{_NAME}]?({'|'.join(UNITS.split())})(?= |$)"


def slots(toks: Column, item: bool = False) -> Column:
    """Array of (pos, type, value) of the placeholders among tokens; of an item without words that it also has in small letters."""
    kind = lambda t: F.when(t < _CAPITAL, F.substring(t, 1, 1)).when(t < _INSIDE, _NAME)
    every = F.transform(toks, lambda t, i: F.struct(i.alias("pos"), kind(t).alias("type"), F.substring(t, 2, 1 << 30).alias("value"), t.alias("t")))
    found = F.filter(every, lambda x: x["type"].isNotNull() & ~(x["t"].startswith(_CAPITAL) & F.array_contains(toks, x["value"])) if item else x["type"].isNotNull())
    return F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["type"].alias("type"), x["value"].alias("value")))


def marked(text: Column) -> Column:
    """The tokens as one string with a space between them."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _MARKS, " " * len(_MARKS))
    numbered = F.regexp_replace(F.regexp_replace(plain, r"(?<=[0-9])(?=[.,:/-][0-9])", _INSIDE), _NUMBERS, f" {_NUMBER}$0 ")
    named = F.regexp_replace(F.regexp_replace(numbered, _NAMES, f"{_NAME}$0"), _CAPITALS, f"{_CAPITAL}$0")
    spaced = F.trim(F.regexp_replace(F.lower(named), _OTHERS, " "))
    return F.regexp_replace(spaced, _UNITS, f"$1 {_UNIT}$2")


def tokens(text: Column) -> Column:
    """Array of tokens, those that may be placeholders behind their sign; of an empty text an empty one."""
    return _split(marked(text))


def _split(united: Column) -> Column:
    return F.when(united == "", F.array().cast("array<string>")).otherwise(F.split(united, " "))


def codes(toks: Column) -> Column:
    """Array of longs: a hash of the word or value, and in the three lowest bits the number of the token's sign, 0 for a plain word."""
    code = lambda t: F.xxhash64(t).bitwiseAND(~7)
    return F.transform(toks, lambda t: F.when(t < _INSIDE, code(F.substring(t, 2, 1 << 30)).bitwiseOR(F.ascii(t).cast("long"))).otherwise(code(t)))


def _kind(c: Column) -> Column:
    return c.bitwiseAND(7)


def _slot(c: Column, names: int) -> Column:
    """The long of a code where numbers, units and names from sign ``names`` on are placeholders; a word keeps its hash whatever its sign."""
    kind = _kind(c)
    return F.when(kind == 0, c).when(kind < 3, kind).when(kind < names, F.lit(3).cast("long")).otherwise(c.bitwiseAND(~7))


#: Names that are placeholders in a document's reading: all with a capital, those inside sentences, none.
_ALL, _INNER, _NONE = 5, 4, 3


def _value(c: Column) -> Column:
    """The long of a code by its value, no placeholder."""
    return F.bitwise_not(c.bitwiseAND(~7))


def _pieces(width: int) -> list[tuple[int, int]]:
    """(start, length) of the runs that a window is hashed by; each length is a power of two."""
    out, at = [], 0
    while at < width:
        size = 1 << ((width - at).bit_length() - 1)
        out.append((at, size))
        at += size
    return out


def _window_keys(df: DataFrame, readings: list[str], widths: list[int]) -> DataFrame:
    """Adds for each reading r and width w an array ``r_w`` of the keys of the windows that begin at each token.

    Keys are hashes of pairs, of pairs of these, and so on; each step is a column of its own, so it is computed once.
    Windows that the end cuts off have keys too, which no whole window has.
    """
    hashed = lambda a, b: F.xxhash64(a, b)
    needed = {size for w in widths for _, size in _pieces(w)}
    held, size = {1}, 1
    kept = [c for c in df.columns if c not in readings]
    df = df.select(*kept, *(F.col(r).alias(f"{r}_runs1") for r in readings))
    while size * 2 <= max(widths):
        stay = [f"{r}_runs{k}" for r in readings for k in held if k in needed]
        df = df.select(*kept, *stay, *(F.zip_with(f"{r}_runs{size}", _from(F.col(f"{r}_runs{size}"), size), hashed).alias(f"{r}_runs{2 * size}") for r in readings))
        held, size = {k for k in held if k in needed} | {2 * size}, 2 * size
    out = {}
    for r in readings:
        for w in widths:
            first, *rest = _pieces(w)
            key = F.col(f"{r}_runs{first[1]}")
            for at, length in rest:
                key = F.zip_with(key, _from(F.col(f"{r}_runs{length}"), at), hashed)
            out[f"{r}_{w}"] = key
    return df.select(*kept, *(k.alias(n) for n, k in out.items()))


def _from(array: Column, at: int) -> Column:
    return F.slice(array, at + 1, F.greatest(F.size(array) - at, F.lit(0)))


def _window_key(place: Callable[[int], Column], width: int) -> Column:
    """The key of one window whose token i has the long place(i)."""
    tree = lambda at, size: place(at) if size == 1 else F.xxhash64(tree(at, size // 2), tree(at + size // 2, size // 2))
    first, *rest = _pieces(width)
    key = tree(*first)
    for at, size in rest:
        key = F.xxhash64(key, tree(at, size))
    return key


def _whole(united: Column) -> Column:
    """The key of a text of too few tokens for windows."""
    return F.xxhash64(F.lit("whole"), F.translate(united, _MARKS, ""))


def document_keys(rows: DataFrame, widths: list[int]) -> DataFrame:
    """(doc, pos, k) of the windows of (doc, text) in each reading, and of texts of under LITERALS tokens as a whole.

    Keys by value are made where numbers and units stand as close as in a window of an item that has such a key.
    """
    united = rows.select("doc", marked(F.col("text")).alias("united"))
    fixed = rf"[{_NUMBER}{_UNIT}]"
    dense = lambda width: F.col("united").rlike(rf"(?:{fixed}[^ ]*(?: [^{_NUMBER}{_UNIT} ][^ ]*){{0,{LITERALS - 1}}} ){{{width - LITERALS}}}{fixed}")
    coded = united.select("doc", codes(_split(F.col("united"))).alias("coded"), _whole(F.col("united")).alias("whole"), *(dense(w).alias(f"dense_{w}") for w in widths))
    readings = {"r0": lambda c: _slot(c, _ALL), "r1": lambda c: _slot(c, _INNER), "r2": lambda c: _slot(c, _NONE), "r3": _value}
    none, close = F.array().cast("array<long>"), F.lit(False)
    for w in widths:
        close = close | F.col(f"dense_{w}")
    read = coded.select("doc", F.size("coded").alias("n"), "whole", *(f"dense_{w}" for w in widths), *(F.transform(F.when(close, F.col("coded")).otherwise(none) if r == "r3" else F.col("coded"), f).alias(r) for r, f in readings.items()))
    keyed = _window_keys(read, list(readings), widths) if widths else read
    parts = [F.col(f"{r}_{w}") for r in ("r0", "r1", "r2") for w in widths] + [F.when(F.col(f"dense_{w}"), F.col(f"r3_{w}")).otherwise(none) for w in widths]
    parts.append(F.when(F.col("n") < LITERALS, F.array_repeat("whole", F.col("n"))).otherwise(none))
    exploded = keyed.select("doc", "n", F.posexplode(F.concat(*parts)).alias("p", "k"))
    return exploded.select("doc", F.pmod("p", "n").alias("pos"), "k")


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item, width, ipos, key) of windows of (item, coded), in every reading that leaves enough words or else by their values."""
    starts = F.sequence(F.lit(0), F.size("coded") - width)
    w = items.filter(F.size("coded") >= width).select("item", F.posexplode(F.transform(starts, lambda i: F.slice("coded", i + 1, width))).alias("ipos", "w"))
    bit = lambda j: F.call_function("shiftleft", F.lit(1), j)
    total = lambda f: F.aggregate(F.transform("w", f), F.lit(0), lambda a, x: a + x)
    w = w.withColumns({"caps": total(lambda x, j: F.when(_kind(x) > 2, bit(j)).otherwise(0)), "fixed": total(lambda x: F.when(_kind(x).isin(1, 2), 1).otherwise(0))})
    masks = F.when(F.col("caps") == 0, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: m.bitwiseAND(F.bitwise_not("caps")) == 0))
    most = F.lit(width - LITERALS) - F.col("fixed")
    at = lambda j: F.element_at("w", j + 1)
    named = lambda j: F.when(F.col("mask").bitwiseAND(1 << j) != 0, F.lit(3).cast("long")).otherwise(_slot(at(j), _NONE))
    templates = w.filter(most >= 0).select("item", "ipos", "w", F.explode(F.filter(masks, lambda m: F.bit_count(m) <= most)).alias("mask")).select("item", "ipos", _window_key(named, width).alias("key"))
    valued = w.filter(most < 0).select("item", "ipos", _window_key(lambda j: _value(at(j)), width).alias("key"))
    return templates.unionAll(valued).select("item", F.lit(width).alias("width"), "ipos", "key").distinct()


def item_keys(items: DataFrame) -> DataFrame:
    """(item, width, ipos, key) of all windows: of ``WINDOW`` tokens, of the item's own length if it has fewer, and of short items as a whole."""
    every = items.filter(F.col("n") < LITERALS).select("item", F.col("n").alias("width"), F.lit(0).alias("ipos"), _whole(F.col("united")).alias("key"))
    for width in range(LITERALS, WINDOW + 1):
        every = every.unionAll(item_windows(items.filter(F.col("n") >= WINDOW if width == WINDOW else F.col("n") == width), width))
    return every


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table that is written already, if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _hits(rows: DataFrame, items: DataFrame, keyed: DataFrame, widths: list[int]) -> DataFrame:
    """(doc, item, pos, ipos, width) of the windows that documents share with items.

    A key of more than ``HOT`` items is looked up only for items that met the document by another key, and for items
    that such keys could cover enough of by themselves.
    """
    counted = cut(keyed.groupBy("key").agg(F.countDistinct("item").alias("holders")), "keys")
    met = cut(document_keys(rows, widths).join(_small(counted), F.col("k") == F.col("key")).select("doc", "pos", "key", "holders"), "met")
    places = keyed.withColumnRenamed("key", "k")
    cold = met.filter(F.col("holders") <= HOT).join(_small(places), F.col("key") == F.col("k")).select("doc", "item", "pos", "ipos", "width")
    hot = keyed.join(counted.filter(F.col("holders") > HOT).select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_semi")
    if hot.isEmpty():
        return cold
    cold = cut(cold, "cold")
    spread = hot.select("item", F.explode(F.sequence(F.col("ipos"), F.col("ipos") + F.col("width") - 1)).alias("place")).groupBy("item").agg(F.countDistinct("place").alias("places"))
    alone = spread.join(items.select(F.col("item").alias("i"), "n"), F.col("item") == F.col("i")).filter(F.col("places") >= COVER * F.col("n")).select(F.col("item").alias("a"))
    hot = cut(hot.join(alone.withColumn("own", F.lit(True)), F.col("item") == F.col("a"), "left").select("item", "width", "ipos", F.col("key").alias("k"), F.coalesce("own", F.lit(False)).alias("own")), "hot")
    warm = met.filter(F.col("holders") > HOT).select("doc", "pos", "key")
    first = warm.join(_small(hot.filter("own")), F.col("key") == F.col("k")).select("doc", "item", "pos", "ipos", "width")
    pairs = cold.select(F.col("doc").alias("d"), F.col("item").alias("i")).distinct()
    rest = warm.join(pairs, F.col("doc") == F.col("d")).join(hot.filter("not own"), (F.col("key") == F.col("k")) & (F.col("i") == F.col("item"))).select("doc", "item", "pos", "ipos", "width")
    return cold.unionAll(first).unionAll(rest)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, covered, item_tokens, slots, changed, kind): a row for each document and item that leaked into it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("item is not null")
    items = items.select("item", marked(F.col("text")).alias("united")).withColumn("tokens", _split(F.col("united")))
    items = cut(items.select("item", "united", F.size("tokens").alias("n"), slots(F.col("tokens"), item=True).alias("slots"), codes(F.col("tokens")).alias("coded")).filter("n > 0"), "items")
    keyed = cut(item_keys(items), "windows")
    widths = sorted(r[0] for r in keyed.filter(F.col("width") >= LITERALS).select("width").distinct().collect())
    hits = cut(_hits(rows, items, keyed, widths), "hits")
    aligned = hits.select("doc", "item", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("i"), "pos", "ipos").select("doc", "item", (F.col("pos") + F.col("i")).alias("pos"), (F.col("ipos") + F.col("i")).alias("ipos")).distinct()
    covered = aligned.groupBy("doc", "item").agg(F.countDistinct("ipos").alias("covered"))
    met = hits.groupBy("doc", "item").agg(F.countDistinct("ipos").alias("windows"))
    sizes = items.select(F.col("item").alias("i"), F.col("n").alias("item_tokens"))
    close = covered.join(met, ["doc", "item"]).join(_small(sizes), F.col("item") == F.col("i")).drop("i").filter(F.col("covered") >= COVER * F.col("item_tokens"))
    close = cut(close, "close")
    doc_slots = rows.join(_small(close.select(F.col("doc").alias("d")).distinct()), F.col("doc") == F.col("d"), "left_semi").select("doc", F.explode(slots(tokens(F.col("text")))).alias("s")).select(F.col("doc").alias("d"), F.col("s.pos").alias("dpos"), F.col("s.type").alias("type"), F.col("s.value").alias("value"))
    item_slots = items.select(F.col("item").alias("i"), F.explode("slots").alias("s")).select("i", F.col("s.pos").alias("spos"), F.col("s.type").alias("itype"), F.col("s.value").alias("ivalue"))
    pairs = aligned.join(_small(item_slots), (F.col("item") == F.col("i")) & (F.col("ipos") == F.col("spos"))).join(doc_slots, (F.col("doc") == F.col("d")) & (F.col("pos") == F.col("dpos")) & (F.col("itype") == F.col("type")))
    from_item, from_doc = F.countDistinct("type", "ivalue"), F.countDistinct("type", "value")
    # an item can stand in a document several times with other values, so each place is checked by itself
    checked = pairs.groupBy("doc", "item", (F.col("pos") - F.col("ipos")).alias("shift")).agg(
        F.countDistinct("ipos").alias("slots"),
        F.count_if(F.col("value") != F.col("ivalue")).alias("changed"),
        ((from_item == F.countDistinct("type", "ivalue", "value")) & (from_doc == F.countDistinct("type", "ivalue", "value"))).alias("fits"),
    )
    checked = checked.groupBy("doc", "item").agg(F.max("slots").alias("slots"), F.min(F.when(F.col("fits"), F.col("changed"))).alias("changed"), F.max("fits").alias("fits"))
    out = close.join(checked, ["doc", "item"], "left")
    changed = F.coalesce("changed", F.lit(0))
    return out.filter(F.coalesce("fits", F.lit(True))).select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "windows", "covered", "item_tokens",
        F.coalesce("slots", F.lit(0)).alias("slots"), changed.alias("changed"),
        F.when(changed > 0, "reparameterised").otherwise("verbatim").alias("kind"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that no benchmark item leaked into, with the columns that they came with."""
    found = cut(leaks(docs, benchmark, id_col).select(F.col("doc_id").alias("leaked_doc")).distinct(), "leaked")
    mark = fresh(docs, "leaked_doc")
    return docs.join(_small(found.toDF(mark)), F.col(id_col).cast("long") == F.col(mark), "left_anti")
