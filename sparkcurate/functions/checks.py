"""Validators of generated text, with their repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions import answers, templates
from sparkcurate.functions.names import clean, sanitise, word_key


def _has(text: Column, piece: Column) -> Column:
    return F.contains(text, piece)


def _words(key: Column) -> Column:
    return F.when(key == "", 0).otherwise(F.size(F.split(key, " ")))


def _padded(key: Column, piece: str) -> Column:
    return _has(F.concat(F.lit(" "), key, F.lit(" ")), F.lit(piece))


def query_ok(obj: Column, part: Column, text: Column, with_can: bool = False) -> Column:
    """A query names the object and the part, says `of`, and has at most 16 words. All
    three arguments are word keys."""
    ok = (text != "") & _has(text, obj) & _has(text, part) & _padded(text, " of ") & (_words(text) <= 16)
    return ok & _padded(text, " that can ") if with_can else ok


def with_queries(
    df: DataFrame, q1: str, q2: str, obj: str = "object", part: str = "part", affordance: str = "affordance"
) -> DataFrame:
    """Add ``query_direct`` and ``query_affordance``: the texts, or their canonical forms
    where they do not hold up, with ``repaired_q1`` and ``repaired_q2``. Each text is
    normalised once, in a step of its own."""
    clean_ = df.withColumns({"_t1": sanitise(F.col(q1)), "_t2": sanitise(F.col(q2))})
    keyed = clean_.withColumns(
        {f"_k{i}": word_key(F.col(c)) for i, c in enumerate(("_t1", "_t2", obj, part))}
    )
    k1, k2, ko, kp = (F.col(f"_k{i}") for i in range(4))
    judged = keyed.withColumns({"_ok1": query_ok(ko, kp, k1), "_ok2": query_ok(ko, kp, k2, with_can=True)})
    o, p, a = F.col(obj), F.col(part), F.col(affordance)
    return judged.select(
        *df.columns,
        F.when(F.col("_ok1"), F.col("_t1")).otherwise(templates.direct_query(p, o)).alias("query_direct"),
        F.when(F.col("_ok2"), F.col("_t2")).otherwise(templates.affordance_query(p, o, a)).alias("query_affordance"),
        (~F.col("_ok1")).alias("repaired_q1"),
        (~F.col("_ok2")).alias("repaired_q2"),
    )


def names_part(part: Column, text: Column) -> Column:
    """The text holds the part, or one of its words of three letters or more; both are
    word keys."""
    long_word = F.exists(F.split(part, " "), lambda w: (F.length(w) >= 3) & F.contains(text, w))
    return (part != "") & (_has(text, part) | long_word)


def instruction_error(obj: Column, part: Column, text: Column, action: Column) -> Column:
    """First failing rule of a task instruction; null when it is valid. All arguments
    are word keys."""
    generic = F.startswith(text, F.lit("use the ")) & (action != "use")
    return (
        F.when(_words(text) < 2, "too_short")
        .when(_words(text) > 16, "too_long")
        .when(names_part(part, text), "contains_part")
        .when(_padded(text, " of "), "contains_of_pattern")
        .when(~_has(text, obj), "missing_object")
        .when(generic, "generic_use")
    )


def instruction_fallback(obj: Column, affordance: Column, action: Column) -> Column:
    """`<Action> the <object>`, or the task sentence of the affordance."""
    act = F.regexp_replace(clean(action), r"\s+", " ")
    capital = F.concat(F.upper(F.substring(act, 1, 1)), F.substr(act, F.lit(2)))
    by_table = F.coalesce(templates.lookup(templates.TASK_FALLBACKS, affordance), F.lit(templates.TASK_DEFAULT))
    return F.when(act != "", F.concat(capital, F.lit(" the "), obj)).otherwise(templates.fill(by_table, obj))


def with_instruction(
    df: DataFrame, text: str, obj: str = "object", part: str = "part", affordance: str = "affordance", action: str = "action"
) -> DataFrame:
    """Add ``valid``, ``instruction``, ``repaired`` and ``instruction_error``: keep a valid
    text, else its fallback if that is valid, else reject with both errors."""
    made = df.withColumns(
        {"_t": sanitise(F.col(text)), "_s": instruction_fallback(F.col(obj), F.col(affordance), F.col(action))}
    )
    keyed = made.withColumns({f"_k{i}": word_key(F.col(c)) for i, c in enumerate((obj, part, action, "_t", "_s"))})
    o, p, a, t, s = (F.col(f"_k{i}") for i in range(5))
    judged = keyed.withColumns({"_e1": instruction_error(o, p, t, a), "_e2": instruction_error(o, p, s, a)})
    first, second = F.col("_e1"), F.col("_e2")
    return judged.select(
        *df.columns,
        (first.isNull() | second.isNull()).alias("valid"),
        F.when(first.isNull(), F.col("_t")).when(second.isNull(), F.col("_s")).alias("instruction"),
        (first.isNotNull() & second.isNull()).alias("repaired"),
        F.when(first.isNotNull() & second.isNotNull(), F.concat(first, F.lit("|fallback:"), second)).alias("instruction_error"),
    )


def repair_caption(original: Column, generated: Column) -> Column:
    """Strip thinking blocks; keep the original when nothing is left; add the object
    when the text does not say `of the`."""
    text = F.nullif(clean(F.regexp_replace(generated, r"(?s)<think>.*?</think>", "")), F.lit(""))
    whole = F.when(F.contains(F.lower(text), F.lit("of the")), text).otherwise(
        F.concat(text, F.lit(" of the "), clean(original))
    )
    return F.when(text.isNull(), original).otherwise(whole)


def with_chat_errors(
    df: DataFrame, image_found: str, pattern: str = answers.FULL_ANSWER_PATTERN, out: str = "errors"
) -> DataFrame:
    """Add the names of the rules a training record (``messages``, ``images``) breaks;
    empty when it is valid. The answer is matched once, in a step of its own."""
    two = F.coalesce(F.size("messages") == 2, F.lit(False))
    texts = df.withColumns(
        {
            "_user": F.coalesce(F.try_element_at("messages", F.lit(1))["content"], F.lit("")),
            "_reply": F.coalesce(F.try_element_at("messages", F.lit(2))["content"], F.lit("")),
            "_missing": F.col("messages").isNull() | F.col("images").isNull(),
        }
    )
    read = texts.withColumns(
        {
            "_g": answers.groups(F.col("_reply"), pattern, 6, at_start=True),
            "_ref": F.regexp_extract("_user", r"<ref>(.+?)</ref>", 1),
        }
    )
    group = [F.get("_g", F.lit(i)) for i in range(6)]
    read = read.withColumns(
        {
            "_two": ~F.col("_missing") & two,
            "_read": ~F.col("_missing") & two & (F.size("_g") == 6),
            "_desc": clean(F.col("_ref")),
            "_now": group[1].try_cast("double"),
            "_next": group[5].try_cast("double"),
            "_x": group[3].try_cast("bigint"),
            "_y": group[4].try_cast("bigint"),
        }
    )
    pair, ok, desc = F.col("_two"), F.col("_read"), F.col("_desc")

    def share(col: str, name: str) -> list[Column]:
        v = F.col(col)
        return [F.when(ok & v.isNull(), f"invalid_{name}"), F.when(ok & ~v.between(0.0, 1.0), f"{name}_out_of_range")]

    inside = F.col("_x").between(0, 1000) & F.col("_y").between(0, 1000)
    rules = [
        F.when(F.col("_missing"), "missing_key"),
        F.when(~F.col("_missing") & ~two, "message_count"),
        F.when(pair & (F.size("images") != 1), "image_count"),
        F.when(pair & ~F.col(image_found), "image_not_found"),
        F.when(pair & ~F.contains("_user", F.lit("<image>")), "no_image_tag"),
        F.when(pair & (F.col("_ref") == ""), "no_user_ref"),
        F.when(pair & (F.col("_ref") != "") & (desc == ""), "empty_description"),
        F.when(pair & ~ok, "bad_answer"),
        F.when(ok & (desc != "") & (clean(group[0]) != desc), "description_mismatch"),
        *share("_now", "current_iou"),
        *share("_next", "next_iou"),
        F.when(ok & ~inside, "coordinate_range"),
    ]
    made = read.withColumn(out, F.array_compact(F.array(*rules)))
    return made.select(*df.columns, out)
