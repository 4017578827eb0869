"""Field names, their labels in documents, and the patterns built from them."""

from __future__ import annotations

import re

# Field names in official order, labels, unit spellings and markers.
FIELDS = ("shipper", "consignee", "notify_party", "port_of_loading", "port_of_discharge", "container_count", "gross_weight_kg")
LABELS: dict[str, tuple[str, ...]] = {
    "shipper": ("exporter / shipper", "exporter/shipper", "shipper / exporter", "shipper/exporter", "shipper", "exporter", "托运人", "託運人", "发货人", "發貨人", "pengirim"),
    "consignee": ("receiving party / consignee", "receiving party/consignee", "to the order of", "consignee", "收货人", "收貨人", "penerima"),
    "notify_party": ("notify party/intermediate consignee", "party to notify", "notify party", "notify", "通知方", "通知人", "pihak untuk dimaklumkan", "pihak dimaklumkan"),
    "port_of_loading": ("port of loading", "portof loading", "load port", "loading port", "pol", "装货港", "裝貨港", "装运港", "裝運港", "pelabuhan muatan", "pelabuhan muat"),
    "port_of_discharge": ("destination port", "port of discharge", "portof discharge", "discharge port", "pod", "卸货港", "卸貨港", "pelabuhan pelepasan", "pelabuhan pemunggahan"),
    "container_count": ("number of containers or packages", "no. of containers or packages", "number of containers", "no. of containers", "container count", "total containers", "containers", "集装箱数量", "集裝箱數量", "货柜数量", "貨櫃數量", "bilangan kontena", "jumlah kontena"),
    "gross_weight_kg": ("total gross weight (kg)", "total gross weight kg", "total gross weight", "total gross wt (kgs)", "total gross wt kgs", "total gross wt", "gross weight毛重(kgs)", "gross weight (kg)", "gross wt (kgs)", "gross weight kg", "gross weight", "gross wt", "毛重", "berat kasar"),
}
BOUNDARY_LABELS = ("b/l no", "b/l number", "bill of lading no", "bill of lading number", "booking", "shipment id", "shipment reference", "ocean vessel", "vessel", "voyage", "export carrier", "container no", "container number", "hs code", "notes", "remarks", "instructions", "date", "航次", "船名", "备注", "catatan", "kapal")
MISSING = ("n/a", "none", "unknown", "-", "not provided", "not available", "n.a", "n.a.")
UNKNOWN_PORT = ("tba", "tbd", "to be advised", "to be confirmed", "to be determined")
CONTAINER_UNITS = ("", "container", "containers", "unit", "units", "kontena", "个", "個", "箱")
KILOGRAMS = ("kg", "kgs", "kilogram", "kilograms")
TONNES = ("mt", "tonne", "tonnes", "tan")
OTHER_WEIGHTS = ("lb", "lbs", "pound", "pounds", "g", "gram", "grams", "ton", "tons")
KILOGRAM_SIGNS, TONNE_SIGNS = ("公斤", "千克"), ("公吨", "公噸", "吨", "噸")
PORTS, PARTIES = FIELDS[3:5], FIELDS[:3]


def alternatives(labels) -> str:
    """The labels as one pattern, longest first."""
    return "|".join(re.escape(x).replace("\\ ", " ") for x in sorted(labels, key=len, reverse=True))


UNIT_WORDS, UNIT_SIGNS = alternatives(KILOGRAMS + TONNES + OTHER_WEIGHTS), alternatives(KILOGRAM_SIGNS + TONNE_SIGNS)
#: Digits, in groups of three after commas if there are any; then a fraction, if there is one.
GROUPED = "[0-9]+(?:,[0-9]{3})*"
FRACTION = r"(?:\.[0-9]+)?"


def leading(*fields: str) -> str:
    """A label of one of ``fields`` at the start, notes in parentheses, and a separator or blanks before the value."""
    return rf"(?iU)^\s*(?:{alternatives(x for f in fields for x in LABELS[f])})(?:\s*\([^()\r\n]*\))*(?:\s*[:=\t|]\s*|\s+)(?=\S)"


def inline(field: str) -> str:
    """A whole label of ``field`` with a separator, anywhere in a line."""
    longer = [x for f, own in LABELS.items() if f != field for x in own]
    parts = []
    for label in sorted(LABELS[field], key=len, reverse=True):
        # a longer label of another field that ends in this one wins
        masks = [re.escape(x[: -len(label)]).replace("\\ ", " ") for x in longer if x.endswith(label) and len(x) > len(label)]
        parts.append("".join(f"(?<!{m})" for m in masks) + re.escape(label).replace("\\ ", " "))
    return rf"(?iU)(?<!\w)(?:{'|'.join(parts)})\s*[:=|]"
