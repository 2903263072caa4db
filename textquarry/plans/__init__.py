"""Query specifications, command front-ends, rendering and the registered queries."""
