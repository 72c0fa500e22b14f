"""Lookup tables and text templates, and the expressions that fill them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.names import clean, lower_name
from sparkcurate.functions.numbers import fixed

# ---------------------------------------------------------------------------
# Results depend on these texts, keep them as they are.
# ---------------------------------------------------------------------------

# "that can be ..." phrase of each affordance.
CAN_PHRASES = {
    "Grasp": "held",
    "Lift": "lifted",
    "Contain": "used to contain items",
    "Open": "opened",
    "Pull": "pulled",
    "Wear": "worn",
    "Move": "moved",
    "Pour": "used to pour liquid",
    "Press": "pressed",
    "Push": "pushed",
    "Display": "viewed",
    "Listen": "listened to",
    "Lay": "laid on",
    "Support": "used to support weight",
    "Sit": "sat on",
    "Wrap": "wrapped",
    "Cut": "cut",
    "Stab": "used to stab",
}

# Task sentence of each affordance; {obj} is the object.
TASK_FALLBACKS = {
    "Open": "Open the {obj}",
    "Press": "Turn on the {obj}",
    "Push": "Move the {obj} forward",
    "Pull": "Pull the {obj}",
    "Pour": "Pour with the {obj}",
    "Contain": "Put something in the {obj}",
    "Display": "Check the {obj}",
    "Listen": "Listen with the {obj}",
    "Wear": "Wear the {obj}",
    "Grasp": "Pick up the {obj}",
    "Lift": "Lift the {obj}",
    "Move": "Move the {obj}",
    "Sit": "Sit on the {obj}",
    "Support": "Use the {obj} for support",
    "Lay": "Place something on the {obj}",
    "Wrap": "Wrap with the {obj}",
    "Cut": "Cut with the {obj}",
    "Stab": "Pierce with the {obj}",
}
TASK_DEFAULT = "Use the {obj}"

# Action verb of each lower-case affordance.
ACTIONS = {
    "open": "open",
    "pull": "pull",
    "press": "press",
    "push": "push",
    "grasp": "hold",
    "carry": "carry",
    "pour": "pour",
    "scoop": "scoop",
    "cut": "cut",
    "wipe": "wipe",
    "sit": "sit on",
    "sit_on": "sit on",
    "wear": "wear",
    "type": "type on",
    "type_on": "type on",
    "support": "support",
    "support_with": "support",
    "lay": "place on",
    "lie_on": "lie on",
    "drink_with": "drink from",
    "eat": "eat with",
    "hold": "hold",
    "move": "move",
    "look_out": "look through",
    "talk_on": "talk on",
    "write": "write with",
    "stir": "stir with",
    "cut_with": "cut with",
    "pack": "pack",
    "text_on": "text on",
    "wash": "wash with",
}

# Known misspellings of label names.
NAME_ALIASES = {
    "bakset": "basket",
    "dinning table": "dining table",
    "moniter/tv": "monitor/tv",
    "table teniis paddle": "table tennis paddle",
}

# Request and answer texts of one training record.
REQUEST_TEXT = (
    "<image>\n"
    "Please optimize the semi-transparent green mask in a point-wise manner "
    "based on the image and description content, so that it covers the target "
    "object as accurately as possible. "
    "The object description is as follows: <ref>{description}</ref>"
)
ANSWER_TEXT = (
    "<ref>{description}</ref> Current IOU: {current_iou}, {sign} point: ({x}, {y}), "
    "Predicted next IOU: {next_iou}"
)
ONE_CLICK_TEXT = "<ref>{description}</ref> Current IOU: 0  {sign} point: ({x}, {y})"

# (object, part, affordances) that do not go together.
BAD_TRIPLES = [
    ("barrel/bucket", "handle", ["Stir"]),
    ("barrel/bucket", "whole_object", ["Eat"]),
    ("bottle", "cap", ["Drink_with"]),
    ("bottle", "label", ["Drink_with"]),
    ("bottle", "lid", ["Drink_with"]),
    ("canned", "cap", ["Drink_with"]),
    ("canned", "lid", ["Drink_with", "Eat"]),
    ("canned", "pull_tab", ["Drink_with"]),
    ("canned", "tab", ["Drink_with"]),
    ("flask", "cap", ["Drink_with"]),
    ("flask", "lid", ["Drink_with", "Sip"]),
    ("bowl/basin", "base", ["Eat"]),
    ("bowl/basin", "whole_object", ["Take_photo"]),
    ("cup", "lid", ["Eat"]),
    ("wine glass", "stem", ["Drink_with", "Eat", "Sip"]),
    ("wine glass", "whole_object", ["Eat"]),
    ("cabinet/shelf", "whole_object", ["Take_photo"]),
    ("desk", "base", ["Eat", "Type_on", "Write"]),
    ("desk", "drawer", ["Write"]),
    ("desk", "drawers", ["Write"]),
    ("desk", "edge", ["Eat", "Type_on", "Write"]),
    ("desk", "leg", ["Eat", "Type_on", "Write"]),
    ("desk", "legs", ["Eat", "Type_on", "Write"]),
    ("nightstand", "surface", ["Talk_on"]),
    ("nightstand", "whole_object", ["Take_photo"]),
    ("fan", "blade", ["Open", "Swing", "Turn_on"]),
    ("fan", "motor", ["Open", "Swing", "Turn_on"]),
    ("lamp", "arm", ["Type_on"]),
    ("lamp", "base", ["Take_photo", "Talk_on", "Type_on"]),
    ("lamp", "head", ["Take_photo", "Type_on"]),
    ("lamp", "lamp_head", ["Take_photo"]),
    ("lamp", "lampshade", ["Talk_on"]),
    ("lamp", "light bulb", ["Take_photo"]),
    ("lamp", "mount", ["Take_photo"]),
    ("lamp", "shade", ["Take_photo", "Talk_on", "Type_on"]),
    ("lamp", "stand", ["Take_photo"]),
    ("lamp", "switch", ["Talk_on"]),
    ("lamp", "whole_object", ["Take_photo"]),
    ("pot", "base", ["Eat"]),
    ("pot", "handle", ["Brush_with"]),
    ("pot", "interior", ["Brush_with"]),
    ("pot", "lid", ["Eat"]),
    ("pot", "whole_object", ["Beat"]),
    ("toilet", "bowl", ["Drink_with"]),
    ("projector", "body", ["Take_photo"]),
    ("projector", "lens", ["Take_photo"]),
    ("boots", "heel", ["Ride"]),
    ("boots", "sole", ["Ride"]),
    ("boots", "toe", ["Ride"]),
    ("boots", "whole_object", ["Ride", "Write"]),
    ("gloves", "whole_object", ["Ride"]),
    ("hat", "whole_object", ["Take_photo"]),
    ("helmet", "shell", ["Ride"]),
    ("helmet", "strap", ["Ride"]),
    ("helmet", "whole_object", ["Ride"]),
    ("high heels", "whole_object", ["Ride", "Take_photo"]),
    ("leather shoes", "sole", ["Ride"]),
    ("leather shoes", "whole_object", ["Ride"]),
    ("sandals", "whole_object", ["Ride"]),
    ("slippers", "sole", ["Ride"]),
    ("slippers", "upper", ["Ride"]),
    ("slippers", "whole_object", ["Ride"]),
    ("sneakers", "heel", ["Ride"]),
    ("sneakers", "sole", ["Ride"]),
    ("sneakers", "surface", ["Write"]),
    ("sneakers", "toe", ["Ride"]),
    ("sneakers", "upper", ["Ride"]),
    ("sneakers", "whole_object", ["Ride"]),
    ("storage box", "whole_object", ["Eat", "Ride", "Take_photo"]),
    ("toilet paper", "whole_object", ["Take_photo"]),
    ("towel", "whole_object", ["Take_photo"]),
]

# ---------------------------------------------------------------------------
# Expressions
# ---------------------------------------------------------------------------


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small constant table; null when the key is absent."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)


def can_phrase(affordance: Column) -> Column:
    return F.coalesce(lookup(CAN_PHRASES, affordance), F.concat(F.lower(affordance), F.lit("ed")))


def action_of(affordance: Column) -> Column:
    key = lower_name(affordance)
    return F.coalesce(lookup(ACTIONS, key), F.replace(key, F.lit("_"), F.lit(" ")))


def fill(template: Column, obj: Column) -> Column:
    return F.replace(template, F.lit("{obj}"), obj)


def task_sentence(obj: Column, affordance: Column) -> Column:
    template = F.coalesce(lookup(TASK_FALLBACKS, clean(affordance)), F.lit(TASK_DEFAULT))
    return fill(template, clean(obj))


def direct_query(part: Column, obj: Column) -> Column:
    return F.concat(part, F.lit(" of the "), obj)


def affordance_query(part: Column, obj: Column, affordance: Column) -> Column:
    return F.concat(F.lit("the "), part, F.lit(" of the "), obj, F.lit(" that can be "), can_phrase(affordance))


def compose_caption(caption: Column, part: Column, obj: Column) -> Column:
    """The caption; else part of the object; else whichever is there; else a default."""
    cap, part, obj = (F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in (caption, part, obj))
    return F.coalesce(cap, direct_query(part, obj), obj, part, F.lit("the target object"))


def request_text(description: Column) -> Column:
    return render(REQUEST_TEXT, description=description)


def click_sign(positive: Column) -> Column:
    return F.when(positive, "Positive").otherwise("Negative")


def render(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by the text of its column."""
    pieces = re.split(r"\{(\w+)\}", template)
    cols = [values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    return F.concat(*cols)


def answer_text(description, current_iou, positive, x, y, next_iou) -> Column:
    return render(
        ANSWER_TEXT, description=description, current_iou=fixed(current_iou, 2), sign=click_sign(positive),
        x=x, y=y, next_iou=fixed(next_iou, 2),
    )


def one_click_text(description, positive, x, y) -> Column:
    return render(ONE_CLICK_TEXT, description=description, sign=click_sign(positive), x=x, y=y)


def chat_record(request: Column, answer: Column, image: Column) -> list[Column]:
    """``messages`` and ``images`` of one training record."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return [
        F.array(message("user", request), message("assistant", answer)).alias("messages"),
        F.array(image).alias("images"),
    ]
