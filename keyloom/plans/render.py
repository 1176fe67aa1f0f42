"""The report as a page, and as CSV."""

from __future__ import annotations

import base64
import csv
import html
import io
import json
import re

from keyloom.functions.formatting import display_key, format_bytesize, format_number

from .report import ReportData

_DATA = re.compile(r'(<script id="report-data"[^>]*>).*?(</script>)', re.S)

PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>Snapshot report</title>
<style>
:root { color-scheme: light dark; font: 14px/1.5 system-ui, sans-serif; }
body { margin: 0 auto; max-width: 1200px; padding: 1rem; }
section { margin: 1.5rem 0; } table { border-collapse: collapse; width: 100%; }
th, td { text-align: left; padding: .2rem .5rem; border-bottom: 1px solid #8884; } th { cursor: pointer; }
.scroll { max-height: 24rem; overflow: auto; } .cards { display: flex; flex-wrap: wrap; gap: 1rem; }
.card { flex: 1 1 16rem; } .bar { background: #48c; height: .5rem; }
.flame div { overflow: hidden; white-space: nowrap; border: 1px solid #fff8; background: #e84; box-sizing: border-box; font-size: 11px; }
.flame { display: flex; } .flame > div { flex-shrink: 0; background: none; border: 0; }
</style></head><body>
<header><h1>Snapshot report</h1><p id="meta"></p><button id="export">Export JSON</button></header>
<section class="cards" id="overview"></section>
<section class="cards" id="shares"></section>
<section><h2>Memory by prefix</h2><div class="flame" id="flame"></div><p id="info"></p></section>
<section><h2>Largest keys</h2><input id="filter" placeholder="filter"><div class="scroll"><table id="keys"></table></div></section>
<section><h2>Issues</h2><ul id="issues"></ul></section>
<script id="report-data" type="application/json">{}</script>
<script>
const data = JSON.parse(document.getElementById("report-data").textContent);
const $ = id => document.getElementById(id);
const el = (tag, text, to) => { const e = document.createElement(tag); e.textContent = text; to.append(e); return e; };
const bytes64 = s => Uint8Array.from(atob(s), c => c.charCodeAt(0));
function shown(s) {
  const raw = bytes64(s);
  try { return new TextDecoder("utf-8", {fatal: true}).decode(raw); }
  catch { return [...raw].map(b => b > 31 && b < 127 ? String.fromCharCode(b) : "\\\\x" + b.toString(16).padStart(2, "0")).join(""); }
}
const size = n => { let u = 0; while (n >= 1024 && u < 5) { n /= 1024; u++; } return (u ? n.toFixed(2) : n) + ["B", "KB", "MB", "GB", "TB", "PB"][u]; };
const total = data.db_aggregates.reduce((s, d) => s + d.total_size, 0);
$("meta").textContent = data.cluster + " \\u00b7 " + data.batch;
for (const [name, value] of [["Total size", size(total)], ["Keys", data.db_aggregates.reduce((s, d) => s + d.key_count, 0)],
  ["Instances", data.instance_aggregates.length], ["Databases", data.db_aggregates.length]]) {
  const c = el("div", "", $("overview")); c.className = "card"; el("b", name, c); el("p", String(value), c);
}
for (const [name, rows, key] of [["By type", data.type_aggregates, "data_type"], ["By database", data.db_aggregates, "db"], ["By instance", data.instance_aggregates, "instance"]]) {
  const c = el("div", "", $("shares")); c.className = "card scroll"; el("b", name, c);
  for (const r of rows) {
    el("div", r[key] + ": " + size(r.total_size) + " (" + (100 * r.total_size / (total || 1)).toFixed(1) + "%)", c);
    const b = el("div", "", c); b.className = "bar"; b.style.width = 100 * r.total_size / (total || 1) + "%";
  }
}
const nodes = data.top_prefixes.map(p => ({...p, raw: atob(p.prefix_base64), children: []})), roots = [], path = [];
for (const n of nodes.sort((a, b) => a.raw < b.raw ? -1 : 1)) {
  while (path.length && !n.raw.startsWith(path[path.length - 1].raw)) path.pop();
  (path.length ? path[path.length - 1].children : roots).push(n); path.push(n);
}
function draw(n, to, of) {
  const box = el("div", "", to); box.style.width = 100 * n.total_size / of + "%";
  const bar = el("div", shown(n.prefix_base64), box);
  bar.onmouseover = () => $("info").textContent = shown(n.prefix_base64) + ": " + n.key_count + " keys, " + size(n.total_size) + ", " + (100 * n.total_size / total).toFixed(1) + "%";
  if (n.children.length) { const row = el("div", "", box); row.className = "flame"; n.children.forEach(c => draw(c, row, n.total_size)); }
}
roots.forEach(n => draw(n, $("flame"), total || 1));
const columns = ["key", "rdb_size", "type", "instance", "db", "member_count", "encoding", "expire_at"];
let order = "rdb_size", down = true;
function table() {
  const t = $("keys"); t.textContent = ""; const head = el("tr", "", t);
  columns.forEach(c => el("th", c, head).onclick = () => { down = order === c ? !down : true; order = c; table(); });
  data.top_keys.map(k => ({...k, key: shown(k.key_base64)})).filter(k => k.key.includes($("filter").value))
    .sort((a, b) => (a[order] > b[order] ? 1 : -1) * (down ? -1 : 1))
    .forEach(k => { const r = el("tr", "", t); columns.forEach(c => el("td", c === "rdb_size" ? size(k[c]) : k[c] ?? "", r)); });
}
$("filter").oninput = table; table();
const issues = data.cluster_issues;
issues.big_keys.forEach(k => el("li", "Big key " + shown(k.key_base64) + ": " + size(k.rdb_size) + " " + k.type + " on " + k.instance, $("issues")));
if (issues.codis_slot_skew) el("li", "Some Codis slots are on several instances", $("issues"));
if (issues.redis_cluster_slot_skew) el("li", "Some cluster slots are on several instances", $("issues"));
$("export").onclick = () => {
  const full = {...data, top_keys: data.top_keys.map(k => ({...k, key: shown(k.key_base64)})), top_prefixes: data.top_prefixes.map(p => ({...p, prefix: shown(p.prefix_base64)}))};
  const a = document.createElement("a"); a.href = URL.createObjectURL(new Blob([JSON.stringify(full, null, 2)])); 
  a.download = ("rdb_report_" + data.cluster + "_" + data.batch + ".json").replaceAll(":", "-"); a.click();
};
</script></body></html>
"""


def render_page(report: ReportData, page: str = PAGE) -> str:
    """The page with the report in its data element; a page without one is an error."""
    # "</" would end the script element.
    payload = json.dumps(json.loads(report.to_json()), indent=2).replace("</", "<\\/")
    out, n = _DATA.subn(lambda m: m[1] + payload + m[2], page, count=1)
    if not n:
        raise ValueError("the page has no element for the report's data")
    return out.replace("<title>Snapshot report</title>", f"<title>{html.escape(report.cluster)} {html.escape(report.batch)}</title>")


def _csv(header: list[str], rows: list[list]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


def prefixes_csv(report: ReportData) -> str:
    """Prefixes by size, largest first."""
    rows = sorted(report.top_prefixes, key=lambda r: (-r["total_size"], r["prefix_base64"]))
    return _csv(
        ["prefix_human", "prefix_base64", "total_size_bytes", "total_size_human", "key_count_raw", "key_count_human"],
        [
            [display_key(base64.b64decode(r["prefix_base64"])), r["prefix_base64"], r["total_size"], format_bytesize(r["total_size"]), r["key_count"], format_number(r["key_count"])]
            for r in rows
        ],
    )


def keys_csv(report: ReportData, contains: str = "", order: str = "rdb_size", descending: bool = True) -> str:
    """The top keys whose text contains ``contains``, in the given order."""
    rows = [{**r, "key": display_key(base64.b64decode(r["key_base64"]))} for r in report.top_keys]
    rows = [r for r in rows if contains in r["key"]]
    rows.sort(key=lambda r: (r[order] is not None, r[order]), reverse=descending)
    return _csv(
        ["key_human", "key_base64", "rdb_size_bytes", "rdb_size_human", "type", "instance", "db", "member_count_raw", "member_count_human", "encoding", "expires"],
        [
            [
                r["key"], r["key_base64"], r["rdb_size"], format_bytesize(r["rdb_size"]), r["type"], r["instance"], r["db"],
                r["member_count"], format_number(r["member_count"]), r["encoding"], r["expire_at"] or "",
            ]
            for r in rows
        ],
    )
