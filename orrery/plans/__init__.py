"""Registered queries, their SQL counterparts and the experiment planner."""
