"""Query registry and the packet tables that queries run on."""
