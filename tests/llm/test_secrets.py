"""Secrets longer than any cap."""

from codeloom.llm import pii


def test_long_secrets_are_redacted_whole():
    for n in (250, 257, 2000, 50_000):
        secret = ("aB3-x_.7Z" * n)[:n]
        assert pii.redact_text(f'token: "{secret}" end', pii.automaton()) == 'token: "[ACCOUNT]" end'
