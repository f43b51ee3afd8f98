"""A bundle to try a release on: two people in turn, in four formats."""

from __future__ import annotations

import json
import sqlite3
from pathlib import Path

# The bundle's people and what stays as it is.
PEOPLE = (("person-001", "Mara Ellison", "mara.ellison@example.invalid", "555-010-4821", "203.0.113.7"), ("person-002", "Jon Bell", "jon.bell@example.invalid", "555-010-9935", "203.0.113.42"))
SECRET, COMPANY, CONTACT, REGIONS = "sk_synthetic_7CWQ0JY5i2", "Northwind Research", "support@example.invalid", ("north", "south", "east")


def written(target: str, records: int) -> Path:
    """policy.json and corpus/ of so many records a format, a record at a time."""
    root = Path(target)
    (root / "corpus").mkdir(parents=True)
    kinds = ("name", "email", "phone", "ip_address")
    rules = [{"rule_id": f"{who}-{k}", "subject_id": who, "type": k, "value": v, "match": "literal", "case_sensitive": k != "email"} for who, *values in PEOPLE for k, v in zip(kinds, values)]
    rules.append({"rule_id": "secret", "type": "secret", "value": SECRET})
    (root / "policy.json").write_text(json.dumps({"version": 1, "sensitive_values": rules, "protected_values": [{"value": COMPANY, "reason": "public"}, {"value": CONTACT, "reason": "public"}]}))
    people = [(i, *PEOPLE[i % len(PEOPLE)][1:], REGIONS[i % len(REGIONS)]) for i in range(min(records, len(PEOPLE) * len(REGIONS)))]
    of = lambda i: (i, *people[i % len(people)][1:])
    with open(root / "corpus" / "customers.csv", "w", newline="") as f:
        f.write("event_id,name,email,region,company\n")
        f.writelines(f"{i},{n},{e},{r},{COMPANY}\n" for i, n, e, _, _, r in map(of, range(records)))
    with open(root / "corpus" / "events.json", "w") as f:
        f.write("[")
        for i, n, e, _, ip, _ in map(of, range(records)):
            f.write((",\n" if i else "") + json.dumps({"event_id": i, "actor": {"name": n, "email": e.upper() if i % 3 == 0 else e}, "network": {"ip": ip}, "event": "login", "metadata": {"approved_contact": CONTACT}}))
        f.write("]\n")
    with open(root / "corpus" / "support-notes.txt", "w") as f:
        f.writelines(f"ticket={i} owner={n} phone={p} status=open company={COMPANY}{' ' + SECRET if i == records - 1 else ''}\n" for i, n, _, p, _, _ in map(of, range(records)))
    db = sqlite3.connect(root / "corpus" / "accounts.sqlite")
    db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, email TEXT NOT NULL UNIQUE, region TEXT NOT NULL)")
    db.execute("CREATE TABLE activity (id INTEGER PRIMARY KEY, user_id INTEGER NOT NULL REFERENCES users (id), detail TEXT NOT NULL)")
    db.execute("CREATE INDEX activity_user ON activity (user_id)")
    db.executemany("INSERT INTO users VALUES (?, ?, ?, ?)", ((k, n, e, REGIONS[k]) for k, (_, n, e, *_) in enumerate(PEOPLE)))
    db.executemany("INSERT INTO activity VALUES (?, ?, ?)", ((i, i % len(PEOPLE), f"{n} logged in from {ip}") for i, n, _, _, ip, _ in map(of, range(records))))
    db.commit()
    db.close()
    return root
