"""Set-oriented operators: conditions, rules, policies, verification, profiling, review, memory, audit."""
