"""Chat control flow on the driver, over the retrieval operators; models are functions of a prompt."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import intent_of, plan_topics
from millrace.operators import search
from millrace.operators.chat import Mentor, TextModel, round_robin, route_from_critic, template_model
from millrace.operators.retrieve import RULE, cite_only, dry_run, whole_context
from millrace.operators.state import Store
from millrace.ops import append_section

Hits = list[tuple[str, str, float]]
COMMANDS = {"search": "search", "kb": "search", "vault": "search", "web": "web", "cite": "cite", "citations": "cite", "dry-run": "dry_run", "dry_run": "dry_run", "dry": "dry_run", "h": "help", "help": "help", "?": "help"}
HELP = "/search, /web, /cite, /dry-run <query>; /help"


def parse_slash(line: str) -> tuple[str | None, str]:
    """Command and query; an unknown command is plain text."""
    head, _, rest = line.strip()[1:].partition(" ")
    cmd = COMMANDS.get(head.lower()) if line.strip().startswith("/") else None
    return (cmd, "" if cmd == "help" else rest.strip()) if cmd else (None, line)


def verdict(raw: str) -> tuple[int, float, str]:
    """{best, score, rationale} of a verifier's answer, also with prose around it; garbage is (0, 0.0, "")."""
    for part in (raw, (re.search(r"\{.*\}", raw, re.S) or [""])[0]):
        try:
            x = json.loads(part)
            return int(x.get("best", 0)), float(x.get("score", 0.0)), str(x.get("rationale", ""))
        except (ValueError, TypeError, AttributeError):
            continue
    return 0, 0.0, ""


def speculative(question: str, chunks: list[str], draft: TextModel, judge: TextModel, drafts: int = 3) -> tuple[str, int]:
    """Drafts from round-robin subsets; the judge picks one. One subset needs no judge; a bad choice is the first."""
    made = [draft(f"{question}\n\n" + "\n---\n".join(s)) for s in round_robin(chunks, drafts)] or [draft(question)]
    best = verdict(judge("\n\n".join(f"[{i}] {d}" for i, d in enumerate(made))))[0] if len(made) > 1 else 0
    return (made[best], best) if 0 <= best < len(made) else (made[0], 0)


@dataclass
class Answer:
    text: str
    citations: Hits
    path: str
    iterations: int = 0


@dataclass
class Agent:
    """route, retrieve, draft, critic and finalise, with at most max_revisions further retrievals."""

    retrieve: Callable[[str], Hits]
    model: TextModel = template_model
    critic: Callable[[str, str], tuple[str, str]] = lambda q, d: ("good", "")
    web: Callable[[str], str] = lambda q: ""
    max_revisions: int = 1
    remember: Callable[[str, str], None] | None = None
    #: What is remembered and pinned for a question, as text that goes before what is found.
    recall: Callable[[str], str] = lambda q: ""
    pinned: Callable[[str], str] = lambda q: ""
    window: int = 8
    history: list[tuple[str, str]] = field(default_factory=list)

    def route(self, question: str) -> str:
        return "direct" if re.fullmatch(r"\s*(hi|hello|hey|thanks|thank you)[\s!.]*", question, re.I) else "retrieve"

    def ask(self, line: str) -> Answer:
        cmd, question = parse_slash(line)
        if cmd == "help":
            return Answer(HELP, [], "help")
        path = {"web": "web", None: self.route(question)}.get(cmd, "retrieve")
        hits: Hits = []
        query, rounds, draft = question, 0, ""
        while True:
            if path == "retrieve":
                hits = self.retrieve(query)
            if cmd == "cite":
                return Answer(cite_only(hits), hits, path)
            if cmd == "dry_run":
                return Answer(dry_run(hits, path, rounds), hits, path)
            found = self.web(question) if path == "web" else RULE.join(t for _, t, _ in hits)
            context = whole_context(self.recall(question), self.pinned(question), found) if path != "direct" else ""
            draft = self.model("\n\n".join(x for x in (question, context) if x))
            if path != "retrieve":
                break
            said, better = self.critic(question, draft)
            rounds += 1
            if route_from_critic(said, rounds, self.max_revisions) == "finalize":
                break
            query = better or question
        self.history = [*self.history, ("user", question), ("assistant", draft)][-self.window :]
        if self.remember and len(draft) >= 16:
            self.remember(question, draft)
        return Answer(draft, hits, path, rounds)

    def stream(self, line: str) -> Iterator[tuple[str, str]]:
        """state, token … and done events."""
        yield "state", "start"
        answer = self.ask(line)
        for token in re.findall(r"\S+\s*", answer.text):
            yield "token", token
        yield "done", answer.path


class Lessons:
    """A mentor over a knowledge base: start gives a plan and its first lesson, tell the next lesson, one back, or an answer.

    find(query, n_results, top_k) gives a context, "" if there is none.
    """

    # Candidates and passages of the first search and of the later ones.
    FIRST, LATER = (20, 10), (10, 5)

    def __init__(self, find: Callable[[str, int, int], str], model: TextModel = template_model, keep: int = 6) -> None:
        self.find, self.model, self.subject, self.state = find, model, "", Mentor([], keep)

    def _say(self, said: str, *parts: str) -> str:
        before = [f"{role}: {text}" for role, text in self.state.history]
        reply = self.model("\n\n".join([*before, *filter(None, parts)]))
        self.state.commit(said, reply)
        return reply

    def start(self, subject: str) -> str:
        self.subject, self.state = subject, Mentor([], self.state.keep)
        context = self.find(subject, *self.FIRST)
        if not context:
            return f"Nothing to teach about {subject} was found."
        reply = self._say(subject, f"Write LEARNING PLAN: and a numbered list of topics about {subject}, then the first lesson.", context)
        self.state.plan = plan_topics(reply)
        return reply

    def tell(self, message: str) -> str:
        intent = intent_of(message) if self.state.plan else "QUESTION"
        if intent == "QUESTION":
            topic = self.state.plan[self.state.at] if self.state.plan else self.subject
            return self._say(message, f"Answer within the topic {topic}: {message}", self.find(message, *self.LATER))
        topic = self.state.move(intent)
        return self._say(message, f"Teach the topic {topic}.", self.find(topic, *self.LATER))


class Memory:
    """Remembered answers at a path: remember, recall by similarity, count, clear."""

    SCHEMA = "id long, session_id string, question string, answer string, ts double"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path, self.SCHEMA, "id")

    def remember(self, question: str, answer: str, session_id: str = "", ts: float | None = None) -> None:
        rows = self.spark.createDataFrame([(session_id, question, answer, time.time() if ts is None else ts)], "session_id string, question string, answer string, ts double")
        self.store.upsert(rows.select(F.xxhash64("session_id", "question", "ts").alias("id"), "*"))

    def recall(self, question: str, k: int = 3) -> DataFrame:
        text = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer")
        held = self.store.read().withColumn("v", search.hash_embed(text))
        q = self.spark.createDataFrame([(0, question)], "id long, t string").withColumn("v", search.hash_embed(F.col("t")))
        return search.dense_topk(held, q, k, "id", "v").join(held, "id").select("rank", "question", "answer", "score").orderBy("rank")

    def count(self) -> int:
        return self.store.read().count()

    def clear(self) -> int:
        n = self.count()
        self.store.recreate()
        return n


class Sessions:
    """Chat sessions and their messages at a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.sessions = Store(spark, f"{path}/sessions", "id string, name string, created_at double", "id")
        self.messages = Store(spark, f"{path}/messages", "id string, session_id string, role string, content string, timestamp double", "id", by="session_id")

    def create(self, session_id: str, name: str, at: float) -> None:
        self.sessions.upsert(self.spark.createDataFrame([(session_id, name, at)], self.sessions.schema))

    def add(self, session_id: str, role: str, content: str, at: float) -> None:
        self.messages.upsert(self.spark.createDataFrame([(f"{session_id}:{at}:{role}", session_id, role, content, at)], self.messages.schema))

    def history(self, session_id: str) -> DataFrame:
        return self.messages.of(session_id).orderBy("timestamp", "id")

    def list(self) -> DataFrame:
        return self.sessions.read().orderBy(F.desc("created_at"), "id")

    def delete(self, session_id: str) -> None:
        gone = self.spark.createDataFrame([(session_id, session_id)], "id string, session_id string")
        self.messages.delete(gone, "session_id")
        self.sessions.delete(gone)

    def export(self, session_id: str) -> str:
        """The transcript as a note with a header."""
        rows = self.history(session_id).collect()
        return f"---\nsession: {session_id}\nturns: {len(rows)}\n---\n\n" + "\n\n".join(f"**{r['role']}**: {r['content']}" for r in rows) + "\n"


class Schedules:
    """Named queries with a cadence: add, list, delete, mark, and those that are due."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path, "name string, cron string, query string, out_path string, last_run string, created_at string", "name")

    def add(self, name: str, cron: str, query: str, out_path: str, created_at: str) -> None:
        if not self.store.read().where(F.col("name") == name).isEmpty():
            raise ValueError(f"schedule {name} exists")
        self.store.upsert(self.spark.createDataFrame([(name, cron, query, out_path, None, created_at)], self.store.schema))

    def due(self, now: str) -> DataFrame:
        from millrace.operators.chat import is_due

        return self.store.read().where(is_due(F.col("cron"), F.col("last_run"), now)).orderBy("created_at", "name")

    def mark(self, name: str, now: str) -> None:
        self.store.upsert(self.store.read().where(F.col("name") == name).withColumn("last_run", F.lit(now)))

    def delete(self, name: str) -> bool:
        return self.store.delete(self.spark.createDataFrame([(name,)], "name string")) > 0

    def run_due(self, now: str, answer: Callable[[str], str]) -> list[tuple[str, str | None]]:
        """Answer every query that is due, append it to its file and mark it: (name, error or None), oldest first.

        One that fails is reported, not marked, and comes again; the others run.
        """
        out = []
        for row in self.due(now).collect():  # a person's schedules
            try:
                append_section(row["out_path"], row["name"], answer(row["query"]), datetime.fromisoformat(now))
                self.mark(row["name"], now)
                out.append((row["name"], None))
            except Exception as e:
                out.append((row["name"], str(e)))
        return out
