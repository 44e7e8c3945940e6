"""Readers of class files, manifests and archives, and the programs over archives."""

import json
import random
import zipfile

import pytest

from strandbase import commands
from strandbase.sinks import manifest_text
from strandbase.sources import dex, manifest_xml, tables
from strandbase.sources.archives import read_archives, read_text_manifests
from tests.archives import apk, binary_manifest
from tests.archives import dex as dex_file

A, B = "Lp/A;", "Lp/B;"
CALL = [0x106E, None, 0]  # invoke-virtual


def program(extra=()):
    f = ("f", ["I", "[Ljava/lang/String;"], "V", [*CALL, 0x0038, 2, 0x000E], [(B, "g", [], "I")])
    return dex_file({A: [f, *extra], B: [("g", [], "I", [0x0012, 0x000F], []), ("none", [], "V", None, [])], "LBare;": []})


def manifest(permissions=("a.P",)):
    uses = [("uses-permission", [("android:name", 3, p), ("android:maxSdkVersion", 0x10, 18)], []) for p in permissions]
    launcher = ("intent-filter", [], [("action", [("android:name", 3, "android.intent.action.MAIN")], []), ("category", [("android:name", 3, "android.intent.category.LAUNCHER")], []), ("data", [("android:scheme", 3, "http"), ("android:host", 3, "h")], [])])
    app = ("application", [("android:allowBackup", 0x12, 0xFFFFFFFF), ("android:icon", 0x01, 0x7F010001)], [
        ("activity-alias", [("android:name", 3, ".Alias")], [launcher]), ("activity", [("android:name", 3, ".First")], []), ("activity", [("android:name", 3, ".Main"), ("android:launchMode", 0x10, 2)], [launcher]),
        ("provider", [("android:authorities", 3, "x.y")], []), ("meta-data", [("android:name", 3, "k"), ("android:value", 0x11, 255)], []), ("uses-library", [("android:name", 3, "lib"), ("android:required", 0x12, 0)], []),
    ])
    root = [("package", 3, "x.app"), ("android:versionCode", 0x10, 7), ("android:versionName", 3, "1.0")]
    return ("manifest", root, [("uses-sdk", [("android:minSdkVersion", 0x10, 21)], []), *uses, ("uses-feature", [("android:glEsVersion", 0x11, 0x20000)], []), app])


def test_opcode_table():
    t = dex.OPCODES
    assert (t[0x6E], t[0x78], t[0x32], t[0x3D], t[0x2A]) == (("InvokeVirtual", 3), ("InvokeInterfaceRange", 3), ("IfEq", 2), ("IfLez", 2), ("Goto32", 3))
    assert (t[0x44], t[0x51], t[0x52], t[0x62], t[0x6D]) == (("AGet", 2), ("APutShort", 2), ("IGet", 2), ("SGetObject", 2), ("SPutShort", 2))
    assert (t[0x7B], t[0x81], t[0x8A], t[0x8D], t[0x8F]) == (("NegInt", 1), ("IntToLong", 1), ("DoubleToInt", 1), ("IntToByte", 1), ("IntToShort", 1))
    assert (t[0x90], t[0x9B], t[0xAF], t[0xCF], t[0xD1], t[0xE2]) == (("AddInt", 2), ("AddLong", 2), ("RemDouble", 2), ("RemDouble2Addr", 1), ("RsubInt", 2), ("UshrIntLit8", 2))
    assert (t[0x0D], t[0x18], t[0x2C], t[0x31], t[0xFA]) == (("MoveException", 1), ("ConstWide", 5), ("SparseSwitch", 3), ("CmpLong", 2), ("InvokePolymorphic", 4))


def test_class_file():
    found = dict(dex.Dex(program()).classes())
    assert list(found) == [A, B, "LBare;"]
    (f,) = found[A]
    assert (f.name, f.descriptor, f.n_named_params) == ("f", "(I[Ljava/lang/String;)V", 1)
    assert [(o.kind, o.opcode) for o in f.ops] == [("Prologue", None), ("Line", None), ("Op", "InvokeVirtual"), ("Op", "IfEqz"), ("Label", None), ("Op", "ReturnVoid")]
    assert f.ops[2].callee == (B, "g", "()I")
    assert [o.opcode for o in found[B][0].ops if o.opcode] == ["Const4", "Return"]
    assert found[B][1].ops == []
    assert dex.java_type("[[Ljava/lang/String;") == "java.lang.String[][]"
    assert "InvokeVirtual Lp/B;->g()I" in dex.smali_text(f)
    with pytest.raises(dex.DexError):
        dex.Dex(b"PK")


def test_broken_class_files_raise_plain_errors():
    good = program()
    rng = random.Random(1)
    for _ in range(300):
        bad = bytearray(good[: rng.randint(0x70, len(good))])
        for _ in range(3):
            bad[rng.randrange(8, len(bad))] = rng.randrange(256)
        try:
            list(dex.Dex(bytes(bad)).classes())
        except Exception as e:
            assert not isinstance(e, (SystemError, MemoryError, RecursionError))


@pytest.mark.parametrize("utf8", [False, True])
def test_binary_manifest(utf8):
    root = manifest_xml.parse(binary_manifest(manifest(), utf8))
    assert root.tag == "manifest"
    assert [(a.name, a.kind, a.text()) for a in root.attrs] == [("package", "String", "x.app"), ("android:versionCode", "Integer", "7"), ("android:versionName", "String", "1.0")]
    again = manifest_xml.parse(manifest_xml.to_xml(root).encode())
    assert [r["tag"] for r in manifest_xml.rows(again)] == [r["tag"] for r in manifest_xml.rows(root)]
    with pytest.raises(manifest_xml.ManifestError):
        manifest_xml.parse(b"\x03\x00")


@pytest.fixture(scope="module")
def pair(tmp_path_factory):
    d = tmp_path_factory.mktemp("apks")
    more = ("h", [], "V", [0x000E], [])
    apk(d / "old.apk", {"classes.dex": program(), "classes2.dex": b"broken", "lib/classes.dex": program(), "AndroidManifest.xml": binary_manifest(manifest(["a.P", "a.Q", "a.Q"]))})
    apk(d / "new.apk", {"classes.dex": program([more]), "AndroidManifest.xml": binary_manifest(manifest(["a.P", "a.R"]), True)})
    apk(d / "bare.apk", {"AndroidManifest.xml": b"nonsense"})
    (d / "bad.apk").write_bytes(b"not an archive")
    return d


def lines(df):
    return [r["line"] for r in df.collect()]


def test_archive_tables(spark, pair, tmp_path):
    made = read_archives(spark, f"{pair}/old.apk")
    assert [(r["class_jni"], r["pkg"], r["dex_ord"]) for r in made["class"].orderBy("class_ord").collect()] == [(A, "p", 0), (B, "p", 0), ("LBare;", "", 0)]
    row = made["method"].filter("name = 'f'").first()
    assert (row["arg_types"], row["ret_type"], row["n_param_entries"], len(row["ops"])) == (["int", "java.lang.String[]"], "void", 1, 6)
    assert [(r["apk_id"], r["entry"]) for r in made["error"].collect()] == [("old", "classes2.dex")]
    every = read_archives(spark, str(pair))["error"]
    assert sorted((r["apk_id"], r["entry"]) for r in every.collect() if r["apk_id"] in ("bad", "bare")) == [("bad", None), ("bare", "AndroidManifest.xml")]
    tables.write_tables({"method": made["method"]}, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t"), "method").filter("side = 'old'").count() == 3


def test_programs(spark, pair, tmp_path, caplog):
    old, new = f"{pair}/old.apk", f"{pair}/new.apk"
    assert lines(commands.callgraph(spark, [old, new])) == ["digraph {", '"p.A:f" -> "p.B:g"; ', "}"]
    assert lines(commands.callgraph(spark, [old], ["B"])) == ["digraph {", "}"]
    assert lines(commands.compare(spark, old, new)) == ["ADDED: p.A: void h([])"]
    commands.extract(spark, old, new, str(tmp_path / "out"))
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.smali")] == ["out/new/p/A/h().smali"]
    assert (tmp_path / "out/old").is_dir()
    csv = commands.match(spark, old, new, csv=True)
    assert [x for df in csv for x in lines(df)][0] == "old_package,new_package,score,status"
    assert lines(csv[1])[0].startswith("p,p,0.") and lines(csv[1])[1] == "(default),---,---,REMOVED"
    assert len(commands.match(spark, old, new, show_details=True, node_matching=True)) == 2
    assert lines(commands.permission_list(spark, new)) == ["a.P", "a.R"]
    assert lines(commands.permission_changes(spark, old, new)) == ["DELETED: a.Q", "DELETED: a.Q", "ADDED: a.R"]
    assert lines(commands.permission_changes(spark, old, f"{pair}/bare.apk")) == []
    with zipfile.ZipFile(tmp_path / "half.apk", "w") as half:
        half.writestr("classes.dex", b"no class file")
    with caplog.at_level("ERROR"):
        assert lines(commands.callgraph(spark, [str(tmp_path / "half.apk"), old])) == ["digraph {", '"p.A:f" -> "p.B:g"; ', "}"]
    assert "half, classes.dex" in caplog.text
    for run in (lambda: commands.callgraph(spark, [f"{pair}/bad.apk"]), lambda: commands.compare(spark, f"{pair}/bad.apk", new), lambda: commands.show_manifest(spark, f"{pair}/bare.apk")):
        with pytest.raises(commands.ArchiveError):
            run()


REPORT = """============================================================
                     ANDROID MANIFEST
============================================================

--- Identity ---
  Package                        x.app
  Version Code                   7
  Version Name                   1.0
  Install Location               (none)
  Platform Build Version Code    (none)
  Platform Build Version Name    (none)
  Main Activity                  .Main

--- SDK ---
  Min SDK Version                21
  Target SDK Version             (none)
  Max SDK Version                (none)

--- Permissions (2 uses-permission, 0 declared) ---
    • a.P
    • a.R

--- Features (1) ---
    • OpenGL ES version: 0x20000

--- Application ---
  Label                          (none)
  Icon                           @0x7f010001
  Name                           (none)
  Allow Backup                   true
  Debuggable                     (none)
  Test Only                      (none)
  Has Code                       (none)
  Hardware Accelerated           (none)
  Large Heap                     (none)
  Supports RTL                   (none)
  Theme                          (none)


    --- Activities (2) ---
    • .First
    • .Main
        Launch Mode: 2
        Intent Filters:
          actions: android.intent.action.MAIN
          categories: android.intent.category.LAUNCHER
          data: http:h

    --- Providers (1) ---
    • 
        Authorities: x.y
          Exported                   (none)
          Read Permission            (none)
          Write Permission           (none)
          Permission                 (none)
          Grant URI Permissions      (none)


    --- Libraries (1) ---
    • lib    required: no


    --- Meta Data (1) ---
    • k
        Value: 0xff

"""


def test_manifest_forms(spark, pair):
    new = f"{pair}/new.apk"
    assert commands.show_manifest(spark, new) == REPORT
    tree = json.loads(commands.show_manifest(spark, new, "json"))
    assert list(tree) == ["package_name", "version_code", "version_name", "install_location", "platform_build_version_code", "platform_build_version_name", "sdk", "uses_permissions", "declares_permissions", "uses_features", "main_activity", "application", "instrumentation", "supports_screens"]
    first, main = tree["application"]["activities"]
    assert "launch_mode" not in first and main["launch_mode"] == "2" and "config_changes" not in main
    assert first["exported"] is None and tree["application"]["label"] is None
    yaml = commands.show_manifest(spark, new, "yaml").splitlines()
    assert yaml[:3] == ["package_name: x.app", "version_code: '7'", "version_name: '1.0'"]
    assert yaml[yaml.index("uses_permissions:") : yaml.index("uses_permissions:") + 3] == ["uses_permissions:", "- a.P", "- a.R"]
    assert "  - name: .First" in yaml and "declares_permissions: []" in yaml
    assert commands.show_manifest(spark, new, "xml").startswith('<?xml version="1.0" encoding="utf-8"?>\n<manifest xmlns:android=')


@pytest.mark.parametrize(("text", "shown"), [
    ("x.y", "x.y"), ("1.2.3", "1.2.3"), ("1.0-beta", "1.0-beta"), ("12_000", "12_000"), ("7", "'7'"), ("-7", "'-7'"), ("1.0", "'1.0'"), (".5", "'.5'"), ("1e5", "'1e5'"), ("007", "'007'"), ("0x1F", "'0x1F'"),
    ("@0x7f010000", "'@0x7f010000'"), ("", "''"), ("null", "'null'"), ("Yes", "'Yes'"), ("yES", "yES"), ("~", "'~'"), (".inf", "'.inf'"), ("2024-01-02", "2024-01-02"), ("12:30", "12:30"), ("a: b", "'a: b'"), ("a:", "'a:'"), ("a:b", "a:b"),
    ("a #b", "'a #b'"), ("a#b", "a#b"), ("#b", "'#b'"), ("- a", "'- a'"), ("-a", "-a"), ("-", "'-'"), ("---", "'---'"), ("?a", "?a"), ("it's", "it's"), ("'a", "'" + "''a'"), ("[a]", "'[a]'"), ("a, b", "a, b"), ("%a", "'%a'"), (" a", "' a'"), ("a ", "'a '"),
    ("a\tb", '"a\\tb"'), ("a\x85b", '"a\\Nb"'), ("é ü", "é ü"), ("日本", "日本"), ("\x01", '"\\x01"'), ("a\nb", "|-\n  a\n  b"), ("a\nb\n", "|\n  a\n  b"), ("a\n\nb", "|-\n  a\n\n  b"), (" a\nb", "|2-\n   a\n  b"), ("a \nb", '"a \\nb"'),
])
def test_yaml_scalars(text, shown):
    assert manifest_text._yaml_scalar(text) == shown


def test_text_manifests(spark, tmp_path):
    (tmp_path / "one.xml").write_text('<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="q"><application android:debuggable="true"/><application android:debuggable="false"/></manifest>')
    (tmp_path / "two.xml").write_text("<manifest>")
    elements, errors = read_text_manifests(spark, str(tmp_path))
    from strandbase.operators.manifest import manifest_summary

    (row,) = manifest_summary(elements).collect()
    assert (row["apk_id"], row["package_name"], row["application"]["debuggable"], row["uses_permissions"], row["supports_screens"], row["main_activity"]) == ("one", "q", True, [], None, None)
    assert [r["apk_id"] for r in errors.collect()] == ["two"]


def test_command_line(spark, pair, capsys, monkeypatch):
    from strandbase import __main__ as cli

    assert cli.main(["permissions", f"{pair}/old.apk", f"{pair}/new.apk"]) == 0
    assert capsys.readouterr().out == "DELETED: a.Q\nDELETED: a.Q\nADDED: a.R\n"
    assert cli.main(["match", f"{pair}/old.apk", f"{pair}/new.apk", "-d", "--node-matching"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].split() == ["Package", "(old)", "Package", "(new)", "Score", "Status"]
    assert "" in out and out[-1].endswith("(added)") or "(removed)" in out[-1]
    assert cli.main(["compare", f"{pair}/bad.apk", f"{pair}/new.apk"]) == 1
    assert capsys.readouterr().err.startswith("Error parsing old apk:")
    assert cli.main(["callgraph", f"{pair}/old.apk", "-f", "["]) == 1
    assert cli.main(["manifest", f"{pair}/new.apk"]) == 0
    assert capsys.readouterr().out == REPORT
