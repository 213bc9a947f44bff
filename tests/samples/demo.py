class Box:
    size: int = 3

    def __init__(self, n):
        self.n = n

    def grow(self, by: int) -> int:
        """Text."""
        for _ in range(by):  # loop
            if by > 3 and self.n:
                self.n += 1
            elif by == 0:
                raise ValueError("no")
            else:
                return 0x10
        return self.n
