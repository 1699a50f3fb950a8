"""Sources and sinks: units of text, rulesets and documents as JSON, decisions by key, requests for decisions, statements."""
