"""The service's chat page: one file, no outside resources. Text of answers and sources is set as text, never as markup."""

PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1"><title>lodestone</title>
<style>
:root { color-scheme: light dark; font: 16px/1.5 system-ui, sans-serif; }
body { max-width: 46rem; margin: 0 auto; padding: 1rem; display: grid; gap: 1rem; }
form { display: grid; grid-template-columns: 1fr auto; gap: .5rem; position: sticky; bottom: 0; padding: .5rem 0; background: Canvas; }
form fieldset { grid-column: 1 / -1; border: 0; padding: 0; margin: 0; display: flex; gap: 1rem; font-size: .9rem; }
input[type=text] { font: inherit; padding: .5rem; }
article { display: grid; gap: .5rem; } article h2 { font-size: 1rem; margin: 0; } article p { margin: 0; white-space: pre-wrap; }
details { font-size: .9rem; border-left: 3px solid; padding-left: .6rem; } details pre { white-space: pre-wrap; margin: .3rem 0; }
.note { font-size: .85rem; opacity: .8; } a.cite { text-decoration: none; font-weight: 600; }
</style></head><body>
<main id="log" aria-live="polite"></main>
<form id="ask"><input type="text" id="question" maxlength="2000" autocomplete="off" aria-label="Question" autofocus><button>Ask</button>
<fieldset><label>Mode <select id="mode"><option>hybrid<option>bm25<option>dense</select></label>
<label>Rerank <select id="rerank"><option>none<option>proximity<option>mmr</select></label>
<label><input type="checkbox" id="llm" checked> language model</label> <button type="button" id="reset">New conversation</button></fieldset></form>
<script>
"use strict";
const by = id => document.getElementById(id), make = (tag, parent, text) => { const e = document.createElement(tag); if (text !== undefined) e.textContent = text; parent.append(e); return e; };
let asked = [], turn = 0;

function cited(target, text, prefix) {
  target.replaceChildren();
  let at = 0;
  for (const m of text.matchAll(/\\[(\\d+)\\]/g)) {
    target.append(text.slice(at, m.index));
    const a = make("a", target, m[0]);
    a.className = "cite"; a.href = "#" + prefix + m[1];
    a.onclick = () => { const d = by(prefix + m[1]); if (d) d.open = true; };
    at = m.index + m[0].length;
  }
  target.append(text.slice(at));
}

function marked(target, text, spans) {
  let at = 0;
  for (const [a, b] of spans || []) { target.append(text.slice(at, a)); make("mark", target, text.slice(a, b)); at = b; }
  target.append(text.slice(at));
}

async function* events(response) {
  const reader = response.body.getReader(), decoder = new TextDecoder();
  let rest = "";
  for (;;) {
    const { value, done } = await reader.read();
    rest += decoder.decode(value || new Uint8Array(), { stream: !done });
    const parts = rest.split("\\n\\n");
    rest = parts.pop();
    for (const part of parts) {
      const field = name => (part.split("\\n").find(l => l.startsWith(name + ": ")) || "").slice(name.length + 2);
      yield [field("event"), JSON.parse(field("data") || "{}")];
    }
    if (done) return;
  }
}

by("reset").onclick = () => { asked = []; by("log").replaceChildren(); by("question").focus(); };
by("ask").onsubmit = async e => {
  e.preventDefault();
  const question = by("question").value.trim();
  if (!question) return;
  by("question").value = "";
  const box = make("article", by("log")), prefix = "t" + ++turn + "-";
  make("h2", box, question);
  const answer = make("p", box, "…"), sources = make("div", box), note = make("div", box);
  note.className = "note";
  let said = "";
  try {
    const body = { question, history: asked.slice(-10), mode: by("mode").value, rerank: by("rerank").value, llm: by("llm").checked };
    const response = await fetch("/api/ask/stream", { method: "POST", headers: { "Content-Type": "application/json" }, body: JSON.stringify(body) });
    if (!response.ok) throw new Error((await response.json()).error);
    for await (const [name, data] of events(response)) {
      if (name === "sources") for (const s of data.sources) {
        const d = make("details", sources);
        d.id = prefix + s.n;
        make("summary", d, `[${s.n}] ${s.source} ${s.heading || ""} (${s.score})`);
        marked(make("pre", d), s.text, s.highlights);
      }
      else if (name === "delta") cited(answer, said += data.text, prefix);
      else if (name === "replace") cited(answer, said = data.text, prefix);
      else if (name === "error") throw new Error(data.error);
      else if (name === "done") note.textContent = [data.question !== question ? "asked as: " + data.question : "", data.warning || ""].filter(Boolean).join(" · ");
    }
    asked.push(question);
  } catch (x) { note.textContent = "failed: " + x.message; }
  box.scrollIntoView({ block: "end" });
};
</script></body></html>
"""
