"""Metric definitions from XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from ..plans.compute import Metric
from ..schema import PROCESSED_SAMPLES

PER_SOCKET = "system.cha_count/system.socket_count"
SAMPLING_METRIC = "metric_EDP EMON Sampling time (seconds)"


def _text(node: ET.Element) -> str:
    return (node.text or "").strip()


def parse(xml: str | bytes) -> list[Metric]:
    out = []
    for m in ET.fromstring(xml).iter("metric"):
        events, constants, latencies = {}, {}, {}
        formula, throughput, description = "", None, None
        name = m.get("name", "")
        for e in m.findall("event"):
            (latencies if "retire_latency" in _text(e) else events)[e.get("alias", "")] = _text(e)
        for c in m.findall("constant"):
            constants[c.get("alias", "")] = "chas_per_socket" if _text(c) == PER_SOCKET else _text(c)
        for f in m.findall("formula"):
            if f.get("socket") is None:
                formula = _text(f).replace(" ", "")
        if name == SAMPLING_METRIC and formula:
            formula += "/samples"
            constants["samples"] = PROCESSED_SAMPLES
        for t in m.findall("throughput-metric-name"):
            throughput = throughput or _text(t) or None
        for d in m.findall("description"):
            description = description or _text(d) or None
        if formula:
            out.append(Metric(name, formula, events, constants, latencies, throughput, description))
    return out


def read(path: str) -> list[Metric]:
    with open(path, "rb") as f:
        return parse(f.read())
