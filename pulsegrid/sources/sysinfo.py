"""System information from the header of a trace."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

END = "Version Info:"
IGNORED = ("Copyright", "Application Build Data")
RULE = "-" * 41
SKIPPED = re.compile(r"^\s*(GPU|QPI|IIO|RAM)\b.*")
SECTIONS = {"Processor Features": "processor", "System Features": "system", "Uncore Performance Monitoring Units": "uncore", "RDT": "rdt"}
FEATURE = re.compile(r"^\s*\(([^():]+)\)\s+\(([^()]*)\)|^\s*\(([^():]+):\s*([^()]*)\)")
FREQUENCY = re.compile(r"([\d.]+)\s*(MHz|GHz)?", re.I)


class HeaderError(ValueError):
    pass


def typed(text: str):
    """Whole numbers (also with commas between thousands), switches and plain text."""
    text = text.strip()
    if any(c.isdigit() for c in text):
        return int(text.replace(",", "")) if re.fullmatch(r"[+-]?(\d+|\d{1,3}(,\d{3})+)", text) else text
    return {"yes": True, "enabled": True, "no": False, "disabled": False}.get(text.lower(), text)


@dataclass
class SystemInfo:
    attributes: dict = field(default_factory=dict)
    features: dict[str, dict] = field(default_factory=lambda: {v: {} for v in SECTIONS.values()})
    processors: list[dict] = field(default_factory=list)
    ref_tsc: float = 0.0

    @property
    def modules(self) -> bool:
        return any("Module" in p for p in self.processors)

    @property
    def sockets(self) -> int:
        return len({p["Phys. Package"] for p in self.processors}) or 1

    @property
    def core_types(self) -> list[str]:
        return sorted({p.get("Core Type", "core") for p in self.processors})

    def topology(self) -> list[dict]:
        """Processors in order of their OS number, as socket, core, thread, module and type."""
        rows = sorted(self.processors, key=lambda p: p["OS Processor"])
        return [{"unit": p["OS Processor"], "socket": p["Phys. Package"], "core": p["Core"], "thread": p["Logical Processor"], "module": p.get("Module", 0), "device": p.get("Core Type", "core")} for p in rows]

    def symbols(self) -> dict[str, float]:
        """Constants that metrics may name."""
        f = self.features
        out = {"system.tsc_freq": self.ref_tsc, "SYSTEM_TSC_FREQ": self.ref_tsc, "system.socket_count": float(self.sockets), "SOCKET_COUNT": float(self.sockets), "DURATIONTIMEINSECONDS": 1.0, "DURATIONTIMEINMILLISECONDS": 1000.0}
        cores, threads = f["processor"].get("Cores Per Package"), f["processor"].get("Threads Per Package")
        if self.processors:
            first = [p for p in self.processors if p["Phys. Package"] == min(q["Phys. Package"] for q in self.processors)]
            cores = cores if isinstance(cores, int) else len({(p.get("Module", 0), p["Core"]) for p in first})
            threads = threads if isinstance(threads, int) else len(first)
        for keys, value in ((("system.sockets[0].cores.count", "CORES_PER_SOCKET"), cores), (("system.sockets[0].cpus.count", "THREADS_PER_SOCKET"), threads)):
            out |= {k: float(value) for k in keys if isinstance(value, int)}
        per_core = f["processor"].get("Threads Per Core")
        per_core = per_core if isinstance(per_core, int) else int(bool(f["processor"].get("Hyper-Threading"))) + 1
        out |= {k: float(per_core) for k in ("THREADS_PER_CORE", "system.sockets[0][0].size")}
        cha = f["uncore"].get("cha")
        if isinstance(cha, int):
            out |= {k: float(cha) for k in ("CHAS_PER_SOCKET", "chas_per_socket", "system.cha_count/system.socket_count")}
        return out


def frequency(text) -> float | None:
    m = FREQUENCY.search(str(text))
    return float(m[1]) * (1e9 if (m[2] or "").lower() == "ghz" else 1e6) if m else None


def parse(lines: list[str], ref_tsc: float | None = None) -> SystemInfo:
    """Read header lines; they have to hold the line that ends the header."""
    info, section, head = SystemInfo(), None, None
    for line in (x.rstrip("\r\n") for x in lines):
        text = line.strip()
        if text.startswith(END):
            break
        if text == RULE:
            head = None if info.processors else head  # the rule after the rows ends the table
            continue
        if text.startswith("OS Processor"):
            head = [h.strip() for h in text.split("\t")]
            continue
        if head and text:
            cells = [c.strip() for c in text.split("\t")]
            info.processors.append({h: int(c) if re.fullmatch(r"\d+", c) else c.strip('"') for h, c in zip(head, cells)})
            continue
        if not text:
            section = None if section == "skip" else section
            continue
        if section == "skip" or text.startswith(IGNORED):
            continue
        found = next((v for k, v in SECTIONS.items() if text.startswith(k)), None)
        if found:
            section = found
            continue
        if SKIPPED.match(text) and ":" not in text and "..." not in text:
            section = "skip"
            continue
        m = FEATURE.match(line)
        if m and section in ("processor", "system"):
            info.features[section][(m[1] or m[3]).strip()] = typed(m[2] if m[1] else m[4])
        elif section in ("uncore", "rdt") and ":" in text:
            k, v = text.split(":", 1)
            info.features[section][k.strip()] = typed(v)
        elif not text.startswith("("):
            if ":" in text:
                k, v = text.split(":", 1)
                info.attributes[k.strip()] = typed(v)
            elif m := re.match(r"(.+?)\s*\.{3,}\s*(.+)", text):
                info.attributes[m[1].strip()] = typed(m[2])
    else:
        raise HeaderError(f"no line begins with {END!r}")
    info.ref_tsc = ref_tsc if ref_tsc and ref_tsc > 0 else 0.0
    for prefix in ("TSC Freq", "Processor Base Freq"):
        if not info.ref_tsc:
            info.ref_tsc = next((f for k, v in info.attributes.items() if k.startswith(prefix) and (f := frequency(v))), 0.0)
    return info
