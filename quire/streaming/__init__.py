"""Task states and progress over streams and their batch replays."""
