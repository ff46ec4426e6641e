"""Flows: graphs of query stages with triggers, routes, retries, sensors, hooks, schedules and records of their runs."""
