"""One manifest summary as JSON, YAML or a report. A summary is one small row, so it is rendered in Python."""

from __future__ import annotations

import json
import re

from pyspark.sql import Row

#: Component fields that are left out when null, labels of the report.
OMITTED_WHEN_NULL = ("launch_mode", "config_changes", "parent_activity_name", "screen_orientation", "window_soft_input_mode")
IDENTITY = {
    "Package": "package_name", "Version Code": "version_code", "Version Name": "version_name", "Install Location": "install_location",
    "Platform Build Version Code": "platform_build_version_code", "Platform Build Version Name": "platform_build_version_name", "Main Activity": "main_activity",
}
SDK = {"Min SDK Version": "min_sdk_version", "Target SDK Version": "target_sdk_version", "Max SDK Version": "max_sdk_version"}
APPLICATION = {
    "Label": "label", "Icon": "icon", "Name": "name", "Allow Backup": "allow_backup", "Debuggable": "debuggable", "Test Only": "test_only",
    "Has Code": "has_code", "Hardware Accelerated": "hardware_accelerated", "Large Heap": "large_heap", "Supports RTL": "supports_rtl", "Theme": "theme",
}
COMPONENT = {
    "Exported": "exported", "Enabled": "enabled", "Permission": "permission", "Process": "process", "Launch Mode": "launch_mode",
    "Config Changes": "config_changes", "Parent Activity": "parent_activity_name",
}
PROVIDER = {
    "Exported": "exported", "Read Permission": "read_permission", "Write Permission": "write_permission", "Permission": "permission",
    "Grant URI Permissions": "grant_uri_permissions",
}
SCREENS = {
    "Resizeable": "resizeable", "Small Screens": "small_screens", "Normal Screens": "normal_screens", "Large Screens": "large_screens",
    "XLarge Screens": "xlarge_screens", "Any Density": "any_density", "Requires Smallest Width DP": "requires_smallest_width_dp",
    "Compatible Width Limit DP": "compatible_width_limit_dp", "Largest Width Limit DP": "largest_width_limit_dp",
}
DATA = ("scheme", "host", "port", "path", "path_pattern", "path_prefix", "mime_type")
BULLET = "    • "


def as_tree(summary: Row | dict) -> dict:
    """The summary as plain dicts and lists, without the columns that name the manifest and without omitted fields."""
    full = summary.asDict(recursive=True) if isinstance(summary, Row) else dict(summary)
    tree = {k: v for k, v in full.items() if k not in ("apk_id", "side")}
    app = tree.get("application")
    for part in ("activities", "services", "receivers") if app else ():
        app[part] = [{k: v for k, v in c.items() if v is not None or k not in OMITTED_WHEN_NULL} for c in app[part]]
    return tree


def render_json(summary: Row | dict) -> str:
    """K7."""
    return json.dumps(as_tree(summary), indent=2, ensure_ascii=False)


#: Words and numbers that a plain scalar would be read as, what no plain scalar begins with or holds, and escapes.
WORDS = {f(w) for w in ("null", "true", "false", "yes", "no", "on", "off", "y", "n") for f in (str.lower, str.capitalize, str.upper)} | {"~", ""}
NUMBER = re.compile(r"[+-]?(?:0x[0-9a-fA-F]+|0o[0-7]+|0b[01]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|\.(?:inf|Inf|INF))|\.(?:nan|NaN|NAN)")
NOT_PLAIN = re.compile(r"""[ #,\[\]{}&*!|>'"%@`]|[?:-](?:[ \t]|$)|---|\.\.\.|.*(?::(?:[ \t]|$)|[ \t]#| $)""")
ESCAPES = {"\0": "0", "\a": "a", "\b": "b", "\t": "t", "\n": "n", "\v": "v", "\f": "f", "\r": "r", "\x1b": "e", '"': '"', "\\": "\\", "\x85": "N", "\u2028": "L", "\u2029": "P"}
UNPRINTED = re.compile("[\x00-\x09\x0b-\x1f\x7f-\x9f\u2028\u2029\ufeff\ufffe\uffff]")


def _escaped(v: str) -> str:
    def shown(m: re.Match) -> str:
        c = m.group()
        return "\\" + (ESCAPES.get(c) or (f"x{ord(c):02X}" if c <= "\xff" else f"u{ord(c):04X}"))

    return '"' + re.sub(f"{UNPRINTED.pattern}|[\n\"\\\\]", shown, v) + '"'


def _yaml_scalar(v: str | bool | None, indent: int = 0) -> str:
    """A value as a plain scalar where it reads back as the same text, else quoted; text of several lines as a literal block,
    whose lines stand ``indent`` + 1 levels deep."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if UNPRINTED.search(v) or re.search(r" \n", v) or ("\n" in v and v[-1] == " "):
        return _escaped(v)
    if "\n" in v:
        deep = "2" if v[0] in " \n" else ""
        chomp = "-" if v[-1] != "\n" else "+" if v == "\n" or v[-2:] == "\n\n" else ""
        lines = v.removesuffix("\n").split("\n")
        return "\n".join([f"|{deep}{chomp}", *("  " * (indent + 1) + x if x else "" for x in lines)])
    if v in WORDS or NUMBER.fullmatch(v) or NOT_PLAIN.match(v):
        return "'" + v.replace("'", "''") + "'"
    return v


def _yaml(v: object, indent: int) -> list[str]:
    pad = "  " * indent
    if isinstance(v, dict):
        out = []
        for k, x in v.items():
            if isinstance(x, (dict, list)) and x:
                out += [f"{pad}{k}:", *_yaml(x, indent + isinstance(x, dict))]
            else:
                out.append(f"{pad}{k}: " + ("[]" if isinstance(x, list) else "{}" if isinstance(x, dict) else _yaml_scalar(x, indent)))
        return out
    out = []
    for x in v:
        if isinstance(x, dict) and x:
            first, *rest = _yaml(x, indent + 1)
            out += [f"{pad}- {first.lstrip()}", *rest]
        else:
            out.append(f"{pad}- {_yaml_scalar(x, indent)}")
    return out


def render_yaml(summary: Row | dict) -> str:
    """K8."""
    return "\n".join(_yaml(as_tree(summary), 0)) + "\n"


def _shown(v: str | bool | None) -> str:
    return "(none)" if v is None else str(v).lower() if isinstance(v, bool) else v


def _pairs(tree: dict, labels: dict[str, str], indent: str = "  ", width: int = 30) -> list[str]:
    return [f"{indent}{label:<{width}} {_shown(tree[field])}" for label, field in labels.items()]


def _set(tree: dict, labels: dict[str, str]) -> list[str]:
    return [f"        {label}: {_shown(tree[field])}" for label, field in labels.items() if tree.get(field) is not None]


def _required(x: dict) -> str:
    return "" if x["required"] is None else f"    required: {'yes' if x['required'] else 'no'}"


def _component(c: dict) -> list[str]:
    out = [BULLET + c["name"], *_set(c, COMPONENT)]
    for f in c["intent_filters"]:
        out.append("        Intent Filters:")
        out += [f"          {k}: {', '.join(f[k])}" for k in ("actions", "categories") if f[k]]
        out += [f"          data: {parts}" for d in f["data"] if (parts := ":".join(d[k] for k in DATA if d[k] is not None))]
    return out


def _block(title: str, items: list, lines: list[str], indent: str = "    ") -> list[str]:
    return ["", f"{indent}--- {title} ({len(items)}) ---", *lines] if items else []


def render_text(summary: Row | dict) -> str:
    """K9-K11."""
    t = as_tree(summary)
    rule = "=" * 60
    out = [rule, f"{'':21}ANDROID MANIFEST", rule, "", "--- Identity ---", *_pairs(t, IDENTITY), "", "--- SDK ---", *_pairs(t["sdk"], SDK), ""]
    uses, declares = t["uses_permissions"], t["declares_permissions"]
    if uses or declares:
        out.append(f"--- Permissions ({len(uses)} uses-permission, {len(declares)} declared) ---")
        out += [BULLET + p for p in uses]
        for d in declares:
            out += [f"{BULLET}{d['name']} (declared)", *_set(d, {"Protection Level": "protection_level"})]
        out.append("")
    if features := t["uses_features"]:
        out.append(f"--- Features ({len(features)}) ---")
        for f in features:
            if f["name"] is not None:
                out.append(BULLET + f["name"] + _required(f))
            elif f["gl_es_version"] is not None:
                out.append(f"{BULLET}OpenGL ES version: {f['gl_es_version']}")
        out.append("")
    if app := t["application"]:
        out += ["--- Application ---", *_pairs(app, APPLICATION), ""]
        for title, part in (("Activities", "activities"), ("Services", "services"), ("Receivers", "receivers")):
            out += _block(title, app[part], [x for c in app[part] for x in _component(c)])
        found = []
        for p in app["providers"]:
            found += [BULLET + p["name"], *_set(p, {"Authorities": "authorities"}), *_pairs(p, PROVIDER, " " * 10, 26)]
        out += _block("Providers", app["providers"], [*found, ""])
        out += _block("Libraries", app["uses_libraries"], [*(BULLET + x["name"] + _required(x) for x in app["uses_libraries"]), ""])
        found = []
        for m in app["meta_data"]:
            found += [BULLET + m["name"], *_set(m, {"Value": "value", "Resource": "resource"})]
        out += _block("Meta Data", app["meta_data"], [*found, ""])
    found = []
    for i in t["instrumentation"]:
        found += [BULLET + i["name"], *_set(i, {"Target Package": "target_package"}), *_pairs(i, {"Handle Profiling": "handle_profiling", "Functional Test": "functional_test"}, " " * 10, 26)]
    out += _block("Instrumentation", t["instrumentation"], [*found, ""], "")
    if screens := t["supports_screens"]:
        out += ["", "--- Supports Screens ---", *_pairs(screens, SCREENS), ""]
    return "\n".join(out) + "\n"


RENDERERS = {"json": render_json, "yaml": render_yaml, "printed": render_text}
