"""Where graphs come from: source trees, git, stored tables and the relational adapter."""
